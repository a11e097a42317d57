import itertools

from pyspark.sql import functions as F

from noticelake.operators import evidence, verdicts
from noticelake.sources import dom, frontier, listing, scans
from noticelake.streaming import feeds


def test_compact_text_keeps_the_best_that_fits():
    text = "\n".join(["head one", "head two", "filler " * 8, "near", "MARK here", "near too", "filler " * 9, "weak"])
    got = evidence.compact_text(text, ["MARK"], ["weak"], ["bad"], 60)
    assert got == "head one\nhead two\nnear\nMARK here\nnear too"
    assert evidence.compact_text(None, ["MARK"], [], [], 5) == ""
    assert evidence.compact_text("x" * 50, ["MARK"], [], [], 7) == "x" * 7
    assert evidence.compact_text(" short\r\n", [], [], [], 99) == "short"


def test_choose_against_a_plain_fold():
    for lengths in itertools.product([1, 4, 9], repeat=5):
        scores = [(7 * n + k) % 4 for k, n in enumerate(lengths)]
        taken = {0, 1}
        for k in sorted((k for k in range(5) if scores[k] > 0), key=lambda k: (-scores[k], k)):
            more = taken | ({k - 1, k, k + 1} & set(range(5)))
            if sum(lengths[j] for j in more) + len(more) - 1 <= 20:
                taken = more
        assert evidence.choose(lengths, scores, 20) == taken


def test_anchors(spark):
    d = spark.createDataFrame([(1, "Grant 2026", "the grant2026 call"), (2, "A long enough title", "nothing"), (3, "", "x"), (4, None, "x")], "k int, t string, b string")
    got = {r.k: (r.a, r.n) for r in d.select("k", evidence.anchors(F.col("t")).alias("a"), evidence.shared_anchors(F.col("t"), F.col("b")).alias("n")).collect()}
    assert got[1] == (["gran", "rant", "ant2", "nt20", "t202", "2026"], 6)
    assert got[2][1] == 0 and got[3] == ([], 0)


def test_listing_rows():
    assert listing.table_rows(None, None) == listing.table_rows("<tr><td>2026-01-01", "") == []
    html = "<tr><td>2026-1-2</td><td><a href='?p=1'>a<b>b</b></a><a href='z'>c</a></td></tr>"
    assert listing.table_rows(html, "https://a.example/x") == [{"published": "2026-01-02", "title": "abc", "url": "https://a.example/x?p=1"}]


def test_reach_with_cycles_and_a_bound(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (2, 3), (3, 4), (3, None), (8, 9)], "node int, target int")
    start = spark.createDataFrame([(1,), (1,), (None,)], "node int")
    found = lambda *a: sorted(tuple(r) for r in frontier.reach(links, start, *a).collect())
    assert found() == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert found(1) == [(1, 0), (2, 1)]
    assert frontier.reach(links, start.limit(0)).count() == 0


def test_revisions_over_batches(spark, tmp_path):
    at = str(tmp_path / "feed")
    feed = lambda: spark.readStream.schema("k int, r string, n int").option("maxFilesPerTrigger", 1).parquet(at)
    write = lambda rows: spark.createDataFrame(rows, "k int, r string, n int").coalesce(1).write.mode("append").parquet(at)
    write([(1, "f", 1), (1, "b", 2), (2, "c", 3)])
    changes, snapshot = feeds.revisions(feed(), "k", "r", "n")
    assert sorted((r.k, r.previous, r.current, r.status) for r in changes.collect()) == [(1, None, "b", "baselined"), (2, None, "c", "baselined")]
    write([(1, "b", 4), (2, "a", 5), (3, "z", 6)])  # a revision that sorts lower is still the later one
    changes, after = feeds.revisions(feed().where("n > 3"), "k", "r", "n", snapshot)
    assert sorted((r.k, r.previous, r.current, r.status) for r in changes.collect()) == [(1, "b", "b", "unchanged"), (2, "c", "a", "changed"), (3, None, "z", "baselined")]
    assert {r.k: r.revision for r in after.collect()} == {1: "b", 2: "a", 3: "z"}
    changes, after = feeds.revisions(feed(), "k", "r", "n")  # both files in one run, one after the other
    assert {(r.k, r.current) for r in changes.collect()} >= {(1, "b"), (2, "a"), (3, "z")} and {r.k: r.revision for r in after.collect()} == {1: "b", 2: "a", 3: "z"}


def test_unknown_profile_is_in_review():
    for detail in ("申請對象限身心障礙之大學生。", "須設籍於臺北市之學生", "", None):
        got = verdicts.decide("示範獎學金", detail, {"special_statuses_confirmed": False} if detail and "身心" in detail else {})
        assert got["status"] == ("ineligible" if detail and "身心" in detail else "review"), got
    assert verdicts.decide(None, None, {})["reasons"] == [verdicts.NOTHING]
    assert verdicts.decide("獎學金", "限日間部。", {"program_type": "進修部"}, "declared_but_missing")["status"] == "review"
    assert verdicts.decide("獎學金", "", {"program_type": "進修部"}, "declared_but_missing", partial="限日間部學生")["status"] == "ineligible"
    assert verdicts.decide("獎學金", "凡大學生可申請", {}, past=["over"])["reasons"] == ["over"]
    assert verdicts.decide("獎學金", "限大學生。" * 20_000, {})["status"] == "eligible"


def test_dom_and_scans_of_broken_pages():
    deep = "<div>" * 20_000 + "x" + "</b>" * 20_000
    assert dom.parse(deep).text() == "x" and dom.parse(None).text() == ""
    page = dom.parse("<p class='a b' id=c>one<br>two<script>no</script><i data-x='1'>three</i></p>")
    assert [n.name for n in page.select(["p.b", "#c", "[data-x='1']", ".nothing"])] == ["p", "i"] and page.text() == "one two three"
    for find in scans.FINDERS:
        spec = scans.Spec("s", find, marks=("/a",), hosts=("h.example",))
        assert scans.scan(None, None, spec) == ([], 0) and scans.scan("<a href", "https://h.example/", spec)[0] == []
    assert scans.scan("", "https://h.example/", scans.Spec("s", "marked_anchors", hosts=("h.example",), entry="入口獎學金"))[0] == [("入口獎學金", "", "https://h.example/")]
    assert scans.known_pages("<a href='?page=3'>3</a><a href='?page=2'>2</a>", "https://h.example/l", 2) == ["https://h.example/l?page=2"]
