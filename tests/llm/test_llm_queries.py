import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import same  # noqa: E402

from noticelake.llm import mixing, queries, simhash, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.run(spark, SF).count() > 0


def odd_rows():
    """Nulls, empty and long texts, repeated rows, near copies and a shared passage."""
    rng = random.Random(21)
    line = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    passage = line(60)
    rows = [(k, line(150), rng.choice(["en", "de", None]), f"src{k % 4}") for k in range(40)]
    rows += [(100 + k, rows[k][1].replace(" ", "  ", 5) + " end", "en", "src1") for k in range(10)]
    rows += [(200 + k, f"{line(30)}\n{passage}\n{line(30)}", "en", "src2") for k in range(6)]
    rows += [rows[3], rows[3], (3, line(40), "en", "src3"), (300, None, "en", None), (301, "", None, "src1"), (302, " \n", "en", "src1"), (None, line(80), "en", "src1"), (None, None, None, None), (None, rows[5][1], "de", "src2")]
    rows += [(400, line(60_000), "en", "src0"), (401, "x" * 400_000, "en", "src0"), (402, "y " * 200_000, "en", "src0")]
    rows += [(500 + k, f"you stupid idiot, what a moron and worthless pathetic loser {k}", "en", "src0") for k in range(3)]
    return rows


def test_stages_against_plain_ones(spark):
    import corpus_pipeline
    from test_simhash import brute_alike
    from test_text import brute_dedup

    rows = odd_rows()
    extra = ["score", "stays", "epoch", "mix_lang", "mix_epochs", "doc", "mark", "segs", "__doc", "id", "fp", "node"]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *range(len(extra))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` int" for x in extra)).repartition(3).cache()
    stages = dict(corpus_pipeline.STAGES)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        seen[name] = [r.asDict() for r in out.collect()]
        assert all(r[x] == k for r in seen[name] for k, x in enumerate(extra)), name
    full = lambda found: sorted((str(r["doc_id"]), str(r["text"])) for r in found)

    lexicon, curve = toxicity.model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = toxicity.score(docs.select("doc_id", "text"), lexicon, curve).collect()
    assert full(seen["toxicity"]) == full(r.asDict() for r in scored if r.score < 0.5)

    sets = [{p for part in simhash.shingles((t or "").encode(), 5) for p in part} or {b""} for _, t, _, _ in rows]
    least = {}
    for group, (ident, *_) in zip(label := brute_alike(sets, True), rows, strict=True):
        least[group] = min((x for x in (least.get(group), ident) if x is not None), default=None)
    stay = {r[0] for r, g in zip(rows, label, strict=True) if r[0] == least[g]}  # rows of one id, and those without, stay or go together
    assert full(seen["near_dedup"]) == full({"doc_id": r[0], "text": r[1]} for r in rows if r[0] in stay)

    named = [(10**9 if r[0] is None else r[0], r[1]) for r in rows]
    distinct = [r for k, r in enumerate(named) if r[0] not in {x[0] for x in named[:k]}]
    few = docs.join(spark.createDataFrame([(x[0],) for x in distinct if [y[0] for y in named].count(x[0]) == 1], "doc_id long"), "doc_id").select(docs.columns)
    out = {r.doc_id: r for r in stages["substring_dedup"](spark, few, SF).collect()}
    want = brute_dedup([(i, t) for i, t in distinct if i in out], 20)
    for ident, row in out.items():
        assert len((row.text or "").split()) == want[ident][0] - want[ident][1] and row.n_chars == (None if row.text is None else len(row.text))

    given = full({"doc_id": r[0], "text": r[1]} for r in rows)
    assert all(full(seen["mixing"]).count(x) <= given.count(x) for x in full(seen["mixing"]))
    words = lambda found: sum(len((r["text"] or "").split()) for r in found)
    assert 0 < words(seen["mixing"]) <= words([{"text": r[1]} for r in rows])

    packed = stages["packing"](spark, docs, SF).collect()
    total = docs.agg(F.sum(mixing.n_tokens(F.col("text")) + 1)).first()[0]
    assert sum(r.n_tokens for r in packed) == total
