import itertools
import math

from lumenqc.llm import common
from lumenqc.llm import url_filter as u


def test_host_path_and_rules(spark):
    rows = [
        (1, "http://A.Example.ORG/es/x?q"), (2, "https://example.org/en/12#t"), (3, "x.example.org"), (4, None), (5, "ftp://b.com/fr/1"), (6, "http://com/de/"),
        (7, "http://notexample.org/es/"), (8, "http://example.org?x"), (9, "a://b.com/FR/://c"), (10, "http://é.net"),
    ]
    table = spark.createDataFrame([(i, x, "<p>text</p>") for i, x in rows], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge(table).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3][:3] == ("", "", None)
    assert got[4][:3] == ("", "", None)
    assert got[5] == ("b.com", "/fr/1", "com/fr/", "allow")
    assert got[6] == ("com", "/de/", "com/de/", "block")
    assert got[7] == ("notexample.org", "/es/", "org/", "allow")
    assert got[8][:3] == ("example.org", "", None)
    assert got[9][:3] == ("b.com", "/FR/://c", None)
    assert got[10][:3] == ("é.net", "", None)


def test_viterbi_against_all_cuts(monkeypatch):
    n = {"the": 50, "rest": 9, "there": 12, "st": 2, "her": 7, "e": 3, "re": 4, "x" * 9: 2, "therest": 1}
    monkeypatch.setattr(u, "STUB", 5)
    total = 100.0

    def cost(cut):
        return sum(math.log(n[w] / total if w in n else 1 / (total * 10 ** len(w))) for w in cut)

    for name in ("therest", "thereher", "xthe", "ststst", "a", "x" * 11, "qqthexx"):
        known = {w: k / total for w, k in n.items() if w in name}
        cuts = []
        for k in range(len(name)):
            for at in itertools.combinations(range(1, len(name)), k):
                ends = [0, *at, len(name)]
                cuts.append([name[a:b] for a, b in itertools.pairwise(ends)])
        assert math.isclose(cost(u.best_cut(name, known, total)), max(map(cost, cuts)))


def pages(spark):
    rows = []
    for i in range(60):
        bad = i % 2
        name = "cheap" + "pills" * (i % 3) if bad else "good" + "news" * (i % 3)
        rows.append((i, f"http://{name}.{'com' if i < 40 else 'net'}/{'de' if bad else 'fr'}/{i}", "<p>cheap pills good news and cheap pills and good news</p>"))
    return spark.createDataFrame([*rows, (60, None, None), (0, *rows[0][1:])], "page_id long, url string, html string")


def test_segmented_words_carry_over(spark):
    rows = u.judge(pages(spark)).collect()
    assert len(rows) == 62
    assert {r.verdict for r in rows if 40 <= r.page_id < 60 and r.page_id % 2} == {"block"}
    assert {r.verdict for r in rows if 40 <= r.page_id < 60 and not r.page_id % 2} == {"allow"}
    hosts = u.host_tokens(spark.createDataFrame([("cheappills.goodnews.net",), ("",)], "host string"), u.word_counts(pages(spark), "html")).collect()
    assert [r.host_tokens[:4] for r in hosts] == [["cheap", "pills", "good", "news"]]


def test_odd_tables(spark):
    none = pages(spark).where("false")
    assert u.judge(none).count() == 0
    one = spark.createDataFrame([(1, None, None, "x")], "page_id long, url string, html string, host string")
    assert [(r.host, r.verdict) for r in u.judge(one).collect()] == [("", "allow")]


def test_words_and_names_of_any_length(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    table = spark.createDataFrame([(1, f"http://{long}kapitaen.net/", f"<p>{long} kapitaen {long}</p>"), (2, f"http://{'ab' * 30_000}.net/x", "<p>ab ab ab ab</p>" + "<!-" * 50_000)], "page_id long, url string, html string")
    hosts = {r.host: r.host_tokens for r in u.host_tokens(u.parts(table, "page_id", "url").select("host").distinct(), u.word_counts(table, "html")).collect()}
    assert hosts[f"{long}kapitaen.net"][:2] == [long, "kapitaen"]
    assert len(hosts[f"{'ab' * 30_000}.net"]) > 29_000
    assert u.judge(table).count() == 2


def test_common_keys_join_apart(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(300, None), (301, "lost")], "row long, key string")
    right = spark.createDataFrame([("hot", 1.0), *((f"k{i}", float(i)) for i in range(300))], "key string, x double")
    for how in ("left", "inner"):
        want = sorted(map(tuple, left.join(right, "key", how).collect()), key=str)
        assert sorted(map(tuple, common.joined(left, right, "key", how, rows=10, shares=20).collect()), key=str) == want
    kept = sorted(r.row for r in common.without(left, right.where("x < 2"), "key").collect())
    assert kept == sorted(i for i in range(302) if i in (300, 301) or i < 300 and i % 3 == 0 and i >= 2)
