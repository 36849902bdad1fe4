"""URL lists: intervals, ties and covering entries beside a plain loop."""

import random

import duckdb

from supplygraph.llm import urls

DAY = 86_400


def test_as_of_join_matches_a_loop(spark):
    rnd = random.Random(7)
    hosts = ["a.com", "m.a.com", "x.m.a.com", "b.org", "c.net"]
    entries = ["a.com", "m.a.com", "org", "b.org/p", "b.org/p/q", "c.net"]
    # a third of all changes and captures are one entry's; some share an instant
    changes = [("l" + str(rnd.randrange(2)), rnd.choice(entries) if rnd.random() < 0.6 else "a.com", rnd.randrange(0, 200) * DAY, rnd.choice(["add", "remove"])) for _ in range(150)]
    changes += changes[:10] + [(None, "a.com", 1, "add"), ("l0", None, 1, "add"), ("l0", "c.net", None, "add"), ("l0", "c.net", 5, "other")]
    captures = [(i, f"https://u@{rnd.choice(hosts)}:80/{rnd.choice(['', 'p', 'p/q/r?x=/y', 'P#p'])}", rnd.randrange(0, 220) * DAY, "blocked") for i in range(400)]
    captures += [captures[0], (900, None, 5, "z"), (901, "no url", 5, "z"), (902, "http://a.com/", None, "z")]
    df = spark.createDataFrame(captures, "page_id long, url string, fetched_at long, entries string")
    log = spark.createDataFrame(changes, "list string, entry string, at long, action string")

    def found(url, at):
        if url is None or at is None or "://" not in url:
            return []
        host, _, path = url.split("://")[1].split("#")[0].split("?")[0].partition("/")
        host = host.split("@")[1].split(":")[0] if "@" in host else host
        labels, folders = host.split("."), [p for p in path.split("/") if p]
        cover = {".".join(labels[k:]) for k in range(len(labels))} | {host + "/" + "/".join(folders[:k]) for k in range(1, len(folders) + 1)}
        out = []
        for name in ("l0", "l1"):
            for entry in sorted(cover):
                past = [(t, action == "add") for li, e, t, action in changes if li == name and e == entry and t is not None and t <= at and action in ("add", "remove")]
                if past and max(past)[1]:
                    out.append(f"{name}:{entry}")
        return sorted(out)

    got = urls.judge(df, log).collect()
    assert len(got) == len(captures)
    for r in got:
        want = found(r.url, r.fetched_at)
        assert (r.n_entries, r.entries, r.blocked) == (len(want), ",".join(want), bool(want)), r


def test_all_columns_stay_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.com/x", 10 * DAY, "k")], "page_id long, url string, fetched_at long, bin string")
    log = spark.createDataFrame([("l", "A.com", DAY, "add")], "list string, entry string, at long, action string")
    assert urls.keep_allowed(df, log).count() == 0
    assert urls.keep_allowed(df, log.limit(0)).collect() == df.collect()
    assert urls.judge(df.limit(0), log).count() == 0


def test_paths_of_entries_are_compared_as_written(spark):
    urls_ = ["https://a.com/Ads/x", "https://A.com./Ads", "https://a.com/ads/x", "https://b.org/P/Q", "https://b.org/P"]
    df = spark.createDataFrame([(i, u, 10 * DAY) for i, u in enumerate(urls_)], "page_id long, url string, fetched_at long")
    log = spark.createDataFrame([("l", e, DAY, "add") for e in ("A.com./Ads", "b.org/P/Q")], "list string, entry string, at long, action string")
    assert {r.page_id: r.entries for r in urls.judge(df, log).collect()} == {0: "l:a.com/Ads", 1: "l:a.com/Ads", 2: "", 3: "l:b.org/P/Q", 4: ""}


def test_derived_entries_with_capitals_match_sql(spark):
    rows = [(i, f"https://h{i % 40}.com/{'Ads' if i % 3 else 'ads'}/X{i % 7}", "") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [r[:2] for r in rows])
    want = con.sql(urls.OP10_SQL)
    got = urls.judge(urls.captures(pages), urls.list_changes(pages)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert any("/Ads" in r.entries for r in got)
