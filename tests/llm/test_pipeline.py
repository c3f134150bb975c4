"""The corpus pipeline, stage by stage, against a brute-force version on a small table."""

import collections
import hashlib
import re

import numpy as np

from tests.llm.test_operators import classes_by_brute_force, removed_by_brute_force  # noqa: F401

SF = "/root/testdata/sf0.001"


def dedup_text(rows, size=100):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            k = b[p : p + size]
            first[k] = min(first.get(k, (d, p)), (d, p))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < (d, p):
                gone[p : p + size] = b"\1" * size
        out[d] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as c
    from rasterloom.llm.bpe_codec import default_vocabulary

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 6000").selectExpr("*", "doc_id as _hit", "1 as _s", "2 as rep")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in c.STAGES] == ["quality_rules", "jaccard_join", "suffix_dedup", "decontamination", "bpe_encoding"]
    kept = []
    for k, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"]: r for r in docs.collect()})

    def good(t):
        words = (t or "").encode().split()
        n = collections.Counter(zip(words, words[1:], words[2:], words[3:], words[4:]))
        hit = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], words[3:], words[4:])) if n[w] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        return not (
            len(words) < 10 or 100 * len(hit) > 20 * len(words) or 10 * sum(t.count(s) for s in "#*$%&|<>") > len(words)
            or 2 * (len(lines) - len(set(lines))) > len(lines) or (t == t.upper() != t.lower() and len(words) >= 20)
        )

    left = {d: t for d, t in rows.items() if good(t)}
    assert set(kept[0]) == set(left)
    want, _ = classes_by_brute_force(list(left.items()))
    left = {d: t for d, t in left.items() if want[d][1] == d}
    assert set(kept[1]) == set(left)
    left = dedup_text(list(left.items()))
    assert {d: r["text"] for d, r in kept[2].items()} == left and all(r["n_chars"] == len(r["text"]) for r in kept[2].values())
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()  # an item of fewer than ten words is one window of its own length
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} - {()}
    sizes = {len(x) for x in windows}
    clean = {d for d, t in left.items() if not any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))}
    assert set(kept[3]) == clean and len(clean) < len(left)
    library = Tokenizer.from_file(default_vocabulary())
    assert set(kept[4]) == clean
    for d, r in kept[4].items():
        ids = library.encode(left[d], add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        back = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], bytes(r["ids"])) == (len(ids), packed)
        assert (r["ids_sha256"], r["decoded_sha256"]) == (hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_run(spark):
    import corpus_pipeline as c

    assert c.ORACLE_SQL is None
    assert c.run(spark, SF).columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def awkward(spark):
    from tests.llm.test_operators import AWKWARD

    good = "One clean sentence of plain words that no rule here has reason to reject at all."
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(AWKWARD)]
    rows += [(50, good, None, None, None), (50, good, None, None, None), (None, good + " Once more.", "en", None, 3), (None, None, None, None, None), (51, "w " * 200_000, "en", "s", 400_000)]
    rows += [(None, "Another clean text, unlike the ones above, from a source that numbers none of its rows.", None, "t", None)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_take_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, no rows, clashing names."""
    import corpus_pipeline as c

    docs = awkward(spark).selectExpr("*", "1 as _hit", "2 as `a.b`", "3 as mark", "text as prefix")
    for start in (docs, docs.limit(0)):
        now = start
        for k, (name, stage) in enumerate(c.STAGES):
            out = stage(spark, now, SF)
            path = str(tmp_path / f"{name}-{start is docs}")
            out.write.parquet(path)
            now = spark.read.parquet(path)
            if k < 4:
                assert out.columns == start.columns
        # of the rows without doc_id one is a near copy of 50, and two are the same
        ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in now.collect())
        assert ids == ([(False, 50), (True, 0)] if start is docs else [])
