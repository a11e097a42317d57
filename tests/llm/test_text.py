import hashlib
import random
import re

import xxhash

from noticelake.llm import fmindex, merkle, substring


def brute_dedup(rows, length):
    seen, out = set(), {}
    for ident, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            key = tuple(words[k : k + length])
            if key in seen:
                gone[k : k + length] = [True] * length
            seen.add(key)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[ident] = (len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def texts(rng):
    few = ["a", "b"]
    many = ["w%d" % k for k in range(300)]
    passage = " ".join(rng.choice(many) for _ in range(60))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a " * 100), (4, "a b " * 60), (5, "one two")]
    for k in range(10, 40):
        rows.append((k, "\n".join([" ".join(rng.choice(many) for _ in range(rng.randint(0, 50))), passage, " ".join(rng.choice(few) for _ in range(rng.randint(0, 60)))])))
    rows += [(50, rows[10][1]), (51, rows[10][1].replace(" ", "\t"))]
    return rows


def test_substring_dedup(spark, monkeypatch):
    rows = texts(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS mark", "3 AS segs").repartition(3)
    for length, hot in ((20, 2000), (20, 2), (7, 2000)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(docs, length, digest=True, hot=hot).collect()}
        assert got == brute_dedup(rows, length)
    kept = {r.doc_id: r.text for r in substring.dedup(docs).collect()}
    want = brute_dedup(rows, 20)
    for ident, text in kept.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert hashlib.sha256(" ".join(words).encode()).hexdigest() == want[ident][2]
    assert kept[0] is None and kept[5] == "one two"
    assert substring.dedup(docs).columns == docs.columns
    assert substring.dedup(docs.limit(0), digest=True).count() == 0


def test_repeated_rows_and_null_ids(spark):
    long = " ".join("w%d" % k for k in range(40))
    docs = spark.createDataFrame([(1, long), (1, long), (None, long)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in substring.dedup(docs, digest=True).collect())
    assert got == [("1", 0), ("1", 0), ("None", 40)]


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(1)
    raw = " ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(900)).encode()
    whole = [tuple(map(int, (s, w))) for _, start, windows, _ in substring.segments([raw], 20) for s, w in zip(start, windows, strict=True)]
    monkeypatch.setattr(substring, "PIECE", 256)
    parts = [tuple(map(int, (s, w))) for _, start, windows, _ in substring.segments([raw], 20) for s, w in zip(start, windows, strict=True)]
    spread = lambda x: sorted(s + k for s, w in x for k in range(w))
    assert spread(parts) == spread(whole) == list(range(900 - 19))


def test_fm_index_counts():
    import numpy as np

    rng = np.random.default_rng(2)
    segs = [rng.integers(1, 4, rng.integers(3, 12)) for _ in range(40)]
    text = np.concatenate([np.r_[s, 0] for s in segs])
    index = fmindex.FMIndex(text, 5)
    for pattern in ([1], [1, 2], [3, 3, 1], [2, 1, 2, 1]):
        lo, hi = np.array([0]), np.array([len(text)])
        for c in reversed(pattern):
            lo, hi = index.back(lo, hi, np.array([c]))
        want = sum(list(s[k : k + len(pattern)]) == pattern for s in segs for k in range(len(s)))
        assert hi[0] - lo[0] == want


def test_fm_index_matches_streams_that_it_does_not_hold():
    import numpy as np

    rng = np.random.default_rng(7)
    for depth in (2, 3, 5, 9):
        segs = [rng.integers(1, 4, rng.integers(1, 14)).tolist() for _ in range(30)]
        index = fmindex.FMIndex(np.array([x for s in segs for x in [*s, 0]]), depth)
        streams = [rng.integers(1, 5, rng.integers(1, 30)).tolist() for _ in range(20)]  # 4 is not in the index
        flat = np.array([x if x < 4 else -1 for s in streams for x in s])
        lengths = np.array([len(s) for s in streams])
        low, high = index.matching(flat, np.cumsum(lengths) - lengths, lengths)
        want = [sum(g[j : j + depth] == s[k : k + depth] for g in segs for j in range(len(g) - depth + 1)) if k + depth <= len(s) else 0 for s in streams for k in range(len(s))]
        assert (high - low).tolist() == want and (any(want) or depth == 9)


def test_substring_dedup_of_every_length(spark):
    rng = random.Random(11)
    few = ["a", "b"]
    passage = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for k in range(40):
        words = [f"x{rng.randrange(10**6)}" for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(1, 3)):
            at, size = rng.randrange(100), rng.randint(5, 150)
            words += passage[at : at + size] + [f"y{rng.randrange(10**6)}"]
        words += rng.choices(few, k=rng.randint(0, 90))
        rows.append((k, " ".join(words)))
    rows += [(100, "q" * 9000 + " " + rows[3][1]), (101, "q" * 9000 + " " + rows[3][1]), (102, "z" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS __doc", "2 AS __segs", "3 AS doc", "4 AS segs")
    for length in (6, 36, 54, 67):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(docs, length, digest=True).collect()}
        assert got == brute_dedup(rows, length)
    assert substring.dedup(docs).columns == docs.columns


def plain_leaves(line):
    """Leaves of a line, byte by byte: up to 40 bytes, then to the end of the word
    (64 at most); a sentence's end and the white space after it close a leaf."""
    out, at, stops, space = [], 0, b".!?", b" \t\n\x0b\x0c\r"
    while at < len(line):
        start, n = at, 0
        while at < len(line) and n < 40 and line[at] not in stops:
            at, n = at + 1, n + 1
        if n:
            n = 0
            while at < len(line) and n < 64 and line[at] not in stops + space:
                at, n = at + 1, n + 1
        for kind in (stops, space):
            n = 0
            while at < len(line) and n < 8 and line[at] in kind:
                at, n = at + 1, n + 1
        out.append(line[start:at])
    return out


def plain_fingerprint(text):
    node = lambda parts: hashlib.blake2b(b"".join(parts), digest_size=16).digest()
    sections, current = [], []
    for line in (text or "").encode().splitlines(True):
        leaves = [xxhash.xxh3_128(x).digest() for x in plain_leaves(line)]
        current.append((node(leaves), leaves))
        if current[-1][0][0] < 64 or not line.strip():
            sections.append(current)
            current = []
    sections += [current] if current else []
    digests = [node([p for p, _ in s]) for s in sections]
    shown = ";".join(d[:4].hex() + ":" + ",".join("".join(x[:3].hex() for x in leaves) for _, leaves in s) for d, s in zip(digests, sections, strict=True))
    return f"{node(digests).hex()}|{shown}"


def plain_likeness(a, b):
    if a[:32] == b[:32]:
        return 1.0
    cut = lambda mark: [line[k : k + 6] for s in mark[33:].split(";") if s for line in s[9:].split(",") for k in range(0, len(line), 6)]
    one, two = cut(a), cut(b)
    both = 0
    for x in one:
        if x in two:
            two.remove(x)
            both += 1
    total = len(one) + len(cut(b))
    return min(2 * both, total - 1) / total


def test_merkle(spark):
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "gamma."]) + str(rng.randint(0, 999)) for _ in range(30))
    rows = [(k, "\n".join(line() for _ in range(rng.randint(1, 8)))) for k in range(1, 25)] + [(30, None), (31, ""), (32, "é\U0001f600x"), (33, "x" * 100_000), (None, "end"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS edge", "'x' AS id").repartition(4)
    got = sorted(tuple(map(str, r)) for r in merkle.edits(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect())
    hashed = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashed[r[1]]))
    want = []
    for (ident, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        marks = [plain_fingerprint(t) for t in (text, edited, after)]
        want.append(tuple(map(str, (ident, len(text), hashlib.sha256(edited.encode()).hexdigest(), *marks[:2], plain_likeness(*marks[:2]), plain_likeness(marks[0], marks[2])))))
    assert got == sorted(want)
    assert merkle.edits(docs.limit(0)).count() == 0
    one = merkle.edits(docs.where("doc_id = 30")).first()
    assert one.near_edited == one.near_next == 1.0


def test_merkle_likeness():
    a = "First line here. Second one.\n" * 3 + "The end of it all.\n"
    b = a.replace("The end", "No end")
    assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(a)) == 1.0
    assert 0.5 < merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) < 1
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("x")) == 0
    raw = a.encode() * 3
    assert b"".join(merkle.LEAF.findall(raw)) == raw


def test_merkle_differences_are_all_that_differs():
    rng = random.Random(9)
    words = ["one", "two.", "three", "four!", "five", "six?", "\n", "\n\n", "seven"]
    without = lambda raw, spans: b"".join(raw[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(raw)], strict=True))
    for _ in range(400):
        a = [rng.choice(words) + str(rng.randint(0, 20)) for _ in range(rng.randint(0, 200))]
        b = a.copy()
        for _ in range(rng.randint(0, 3)):
            at, size = rng.randint(0, len(b)), rng.randint(0, 12)
            b[at : at + size] = [rng.choice(words) for _ in range(rng.randint(0, 5))]
        a, b = " ".join(a), " ".join(b)
        one, two = merkle.tree(a), merkle.tree(b)
        assert one.digest.hex() == merkle.fingerprint(a).partition("|")[0]
        mine, theirs = merkle.differences(one, two)
        assert bool(mine or theirs) == (a != b)
        assert mine == sorted(mine) and without(a.encode(), mine) == without(b.encode(), theirs)
    long = "\n".join("line %d of a long text that goes on." % k for k in range(5000))
    mine, theirs = merkle.differences(merkle.tree(long), merkle.tree(long.replace("line 2500 of", "LINE 2500 of") + "\nappended"))
    assert sum(e - s for s, e in mine) < 200 and sum(e - s for s, e in theirs) < 200 and len(theirs) >= 2
