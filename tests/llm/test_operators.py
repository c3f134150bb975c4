"""The training-data operators against the libraries, brute force and round trips, on small fixtures."""

import collections
import hashlib
import random
import re

import pytest

SF = "/root/testdata/sf0.001"
AWKWARD = [None, "", " ", "a", "  a  b ", "\n\nx\ny", "</s>[INST]", "<|endoftext|>x", "é漢🙂 Ünï", "x" * 5000, "the cat sat on the mat " * 40, "\x00\t\x0b"]


def documents(spark, texts, ids=None, extra=True):
    ids = ids or list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    if extra:  # columns whose names the operators could use themselves
        from pyspark.sql import functions as F

        for name in ("rep", "n", "_hit", "_m", "mark", "label", "node", "d", "q", "kept", "n_tokens", "_s", "prefix", "k", "t"):
            df = df.withColumn(name, F.lit(7))
    return df.repartition(3)


def corpus(spark, n=60):
    """Real rows, some repeated, with awkward ones."""
    rows = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").limit(n).collect()]
    return rows + [rows[3], rows[5]] + AWKWARD


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return {k: v[0] for k, v in out.items()} if all(len(set(v)) == 1 for v in out.values()) else out


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    from rasterloom.llm.token_counts import default_model, token_counts

    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = corpus(spark)
    got = by_id(token_counts(documents(spark, texts), limit=50))
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 50), i
        assert len(sp.encode((t or "")[: got[i]["fit_chars"]])) <= 50
    assert token_counts(empty(spark)).count() == 0


def test_prefix_counts_are_exact_at_every_prefix():
    import sentencepiece

    from rasterloom.llm.token_counts import counter, default_model

    sp, c, rng = sentencepiece.SentencePieceProcessor(model_file=default_model()), counter(default_model()), random.Random(5)
    parts = ["a", "th", "ing", " ", "   ", "\n", "é", "漢", "▁", "\t", "</s>", "🙂", "tion", "."]
    for _ in range(150):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 18)))
        exact = [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
        assert list(c.prefix_counts(t)) == exact, t
        for budget in (0, 2, 5):
            assert c.fit(t, budget) == max(i for i, n in enumerate(exact) if n <= budget)
    for k in (1, 2, 13, 14, 15, 16, 31, 200):
        assert c.count(" " * k) == len(sp.encode(" " * k))


def test_stored_prefix_counts_answer_budgets(spark):
    import sentencepiece

    from rasterloom.llm.token_counts import default_model, prefix_table, within

    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = [t for t in corpus(spark, 8) if len(t or "") < 700] + ["word " * 60]
    stored = prefix_table(documents(spark, texts), piece=50).cache()
    got = collections.defaultdict(dict)
    for r in stored.collect():
        got[r["doc_id"]] |= {r["start"] + i: n for i, n in enumerate(r["counts"])}
        assert len(r["counts"]) <= 50
    for i, t in enumerate(texts):
        assert got[i] == {k: len(sp.encode((t or "")[:k])) for k in range(len(t or "") + 1)}, i
    for budget in (0, 3, 40):
        fits = {r["doc_id"]: r["fit_chars"] for r in within(stored, budget).collect()}
        assert fits == {i: max(k for k, n in got[i].items() if n <= budget) for i in range(len(texts))}
    assert prefix_table(empty(spark)).count() == 0


def removed_by_brute_force(rows, size=100):
    first = {}
    key = lambda d: (1 << 63) - 1 if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            k = b[p : p + size]
            first[k] = min(first.get(k, (key(d), p)), (key(d), p))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < (key(d), p):
                gone[p : p + size] = b"\1" * size
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return collections.Counter(out)


def repeated_rows():
    rng = random.Random(3)
    base = "".join(rng.choice("abé d") for _ in range(2500))
    rows = []
    for i in range(40):
        t = ""
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, 2400)
            t += base[at : at + rng.randint(5, 400)]
            if rng.random() < 0.5:
                t += "".join(rng.choice("xyz") for _ in range(rng.randint(1, 150)))
        rows.append((i, t))
    return rows + [(100, "a" * 500), (101, "a" * 99), (102, "a" * 100), (103, None), (104, ""), (105, "ab" * 200), (5, rows[5][1]), (None, rows[7][1]), (None, "n" * 120)]


#: Hints off, hot anchors dealt in groups, and crowded ones split into windows.
DEALING = [(64, 16), (1, 3), (1, 1)]


@pytest.mark.parametrize("sample,hot", DEALING)
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, sample, hot):
    from rasterloom.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "SAMPLE", sample)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 10)
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)  # texts run over pieces
    rows = repeated_rows()
    df = documents(spark, [t for _, t in rows], [d for d, _ in rows])
    assert collections.Counter(tuple(r) for r in suffix_dedup.removals(df).collect()) == removed_by_brute_force(rows)
    assert suffix_dedup.removals(empty(spark)).count() == 0


def test_suffix_order_sorts_and_survives_collisions(monkeypatch):
    import numpy as np

    from rasterloom.llm import suffix_sort

    rng = random.Random(2)
    text = bytes(rng.choice(b"ab") for _ in range(600))
    data, starts = np.frombuffer(text, np.uint8), np.array([rng.randrange(590) for _ in range(200)])
    classes = np.array([rng.randrange(3) for _ in starts])
    for broken in (False, True):
        if broken:  # all hashes equal: every comparison is a collision
            monkeypatch.setattr(suffix_sort.Hashes, "of", lambda self, start, size: np.zeros(len(start), np.uint64))
        order, same = suffix_sort.suffix_order(data, starts, classes, 8)
        keys = [(classes[i], text[starts[i] : starts[i] + 8]) for i in order]
        assert keys == sorted(keys)
        assert list(same) == [k > 0 and keys[k] == keys[k - 1] for k in range(len(keys))]


def test_chat_format_reads_back(spark):
    from rasterloom.llm.chat_format import digests, formatted

    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\<|turn|>", "<\\|done|>", "<|says|>\n", "<<s>>", "", None, "<|turn|><|done|>"]
    rows = [(i, t, r, x) for i, x in enumerate(nasty) for t, r in ((1, "assistant"), (0, "user"))]
    rows += [(50, 0, "user", "a"), (50, 1, "user", "b"), (51, 0, None, "x"), (52, None, "user", "q"), (52, 1, "assistant", "r"), (53, 0, "<|turn|>", "z"), (None, 0, "user", "n")]
    out = formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in digests(out).collect()}
    whole = {r["conv_id"]: r for r in out.collect()}
    turns = collections.defaultdict(list)
    for conv, t, r, x in sorted(rows, key=lambda z: (z[0] is not None, z[0] or 0, z[1] is not None, z[1] or 0, z[2] or "", z[3] or "")):
        turns[conv].append((r or "", x or ""))
    for conv, said in turns.items():
        text = "".join(f"{r}\n{x}\n" for r, x in said)
        loss = "".join(x for r, x in said if r == "assistant")
        g = got[conv]
        assert g["n_turns"] == len(said) and g["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest(), conv
        assert g["loss_chars"] == len(loss) and g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest(), conv
        assert g["formatted_chars"] == len(whole[conv]["formatted"])
        body = whole[conv]["formatted"]
        assert body.count("<|turn|>") == body.count("<|done|>") == len(said) and "</s>" not in body and "[INST]" not in body
    assert got[0]["valid"] and not got[50]["valid"] and got[50]["breaks_at"] == 1 and got[51]["breaks_at"] == 0


def test_chat_format_of_awkward_tables(spark, tmp_path):
    from rasterloom.llm.chat_format import digests, formatted, op3_chat_format

    schema = "conv_id long, turn long, role string, text string"
    none = spark.createDataFrame([], schema)
    assert digests(formatted(none)).count() == 0
    none.write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r["conv_id"] for r in op3_chat_format(spark, str(tmp_path)).collect()] == [-7]  # the probe alone
    long = "[INST] </s> \\ word " * 20_000
    rows = [(1, 0, "user", "same")] * 3 + [(2, 0, "user", long), (2, 1, "assistant", long)]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as turns", "2 as segments", "3 as loss", "4 as walk")
    got = {r["conv_id"]: r for r in digests(formatted(df)).collect()}
    assert got[1]["n_turns"] == 3 and not got[1]["valid"] and got[1]["breaks_at"] == 1
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nsame\n" * 3).hexdigest()
    assert got[2]["loss_chars"] == len(long) and got[2]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()


def test_quality_ledger(spark):
    from rasterloom.llm import quality_rules as q

    texts = corpus(spark)
    led = q.ledger(documents(spark, texts)).cache()
    got = by_id(q.apply_policy(led))
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        wins = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        n = collections.Counter(wins)
        hit = {k + j for k, w in enumerate(wins) if n[w] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum((t or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, i
        assert got[i]["base_failed"] == (len(words) < 10 or 100 * len(hit) > 20 * len(words))
    rows = {r["rule"]: r for r in q.ablations(led).collect()}
    masks = [r["failed"] for r in led.collect()]
    for k, rule in enumerate(q.RULES):
        assert rows[rule]["fails"] == sum(m >> k & 1 for m in masks) and rows[rule]["only"] == sum(m == 1 << k for m in masks)
    assert q.ledger(empty(spark)).count() == 0


def test_quality_keeps_good_and_drops_bad(spark):
    from rasterloom.llm import quality_rules as q

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = q.apply_policy(q.ledger(docs)).join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    assert all(good) and not any(r["kept"] for r in rows if r["quality"] == 0)


URLS = [
    None, "", "no scheme", "http://NET/x", "http://a.b.net/", "http://example.net/en/1", "http://www.example.net/fr/", "https://x.example.com/de/y?q#f",
    "http://planet/", "http://site.org/fr/a", "http://site.org/en/a", "http://free-casino.example.xyz/porn/slots", "http://news.example.gov/report", "ftp://A://b/c", "http://net", "x\n://net/",
    "http://é漢🙂.example.com/ü", "://", "http://" + "casino-" * 4000 + ".com/" + "x/" * 20_000, "http://free-casino.example.xyz/porn/slots",
]


def test_url_filter_equals_brute_force(spark):
    import math

    from rasterloom.llm import url_filter as u

    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "1 as host", "2 as p_block", "3 as rule")
    weights, bias = u.train()
    rows = u.judged(pages, (weights, bias)).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        url = URLS[r["page_id"]] or ""
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [k for k in u.RULES if (host == k.split("/", 1)[0] or host.endswith("." + k.split("/", 1)[0])) and path.startswith("/" + k.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        grams = [f"{mark}{n}:{('^' + part + '$')[i : i + n]}" for part, mark in ((host, "h"), (path, "p")) if part for n in u.SIZES for i in range(len(part) + 3 - n)]
        slots = [int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % u.SLOTS for g in grams]
        p = 1 / (1 + math.exp(-(bias + sum(weights[s] for s in slots) / math.sqrt(max(1, len(slots))))))
        verdict = u.RULES[rule] if rule else ("block" if p >= u.BLOCK_FROM and (host or path) else "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), url[:80]
        assert abs(r["p_block"] - p) < 1e-6
    assert u.judged(pages.limit(0), (weights, bias)).count() == 0


def blocked(spark, urls, model=None):
    from rasterloom.llm import url_filter as u

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r["page_id"] for r in u.judged(pages, model, {"none/": "allow"}).collect() if r["verdict"] == "block"}


def test_url_filter_blocks_hosts_without_a_learned_word(spark):
    from rasterloom.llm import url_filter as u

    # hosts of the test table, seen by eye to be spam; none of their words is in the training table
    marks = "free-bets casino-win cheap-pills ads-track adult-x spam-farm".split()
    assert not {w for m in marks for w in m.split("-")} & {*u.PLAIN_WORDS, *" ".join(u.SPAM_FAMILIES.values()).split()}
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("url like '%://%'").collect()
    got = blocked(spark, [r["url"] for r in rows])
    bad = {i for i, r in enumerate(rows) if any(m in r["url"] for m in marks)}
    assert len(bad) > 100 and len(got & bad) >= 0.8 * len(bad) and len(got - bad) < 0.01 * (len(rows) - len(bad))


@pytest.mark.parametrize("family", ["gambling", "money", "fakes"])
def test_url_filter_blocks_held_out_families(spark, family):
    """Of a family of words that training never saw, names are told by their other traits: far from all."""
    from rasterloom.llm import url_filter as u

    rows = u.labelled(family)
    assert not any(w in x.split("://")[1].split("/")[0] for w in u.SPAM_FAMILIES[family].split() if len(w) > 5 for x, _ in rows)
    urls = u.of_family(family)
    assert len(blocked(spark, urls, u.train(tuple(rows)))) >= 0.4 * len(urls)
    assert len(blocked(spark, urls)) >= 0.85 * len(urls)  # with the family learned


def test_url_filter_leaves_ordinary_names(spark):
    from rasterloom.llm import url_filter as u

    rng = random.Random(6)
    names = [u._invented(f"other{i}") for i in range(150)] + ["".join(rng.choice(u.PLAIN_WORDS) for _ in range(rng.randint(1, 2))) for _ in range(150)]
    assert len(blocked(spark, [f"https://{n}.example.org/en/{i}" for i, n in enumerate(names)])) <= 0.02 * len(names)


def test_url_filter_is_native(spark):
    from rasterloom.llm import url_filter as u

    plan = u.op5_url_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return frozenset({tuple(w)} if 0 < len(w) < 5 else zip(w, w[1:], w[2:], w[3:], w[4:]))


def components_by_brute_force(rows):
    """For each row its set's size and its component's smallest doc_id."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, s in enumerate(sets):
        for j in range(i):
            t = sets[j]
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if s and t and (same_id or 100 * len(s & t) >= 75 * len(s | t)):
                up[max(top(i), top(j))] = min(top(i), top(j))
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[top(i)].append(d)
    return [(d, len(s), (min(ids[top(i)], default=None) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def classes_by_brute_force(rows):
    return {d: (n, c) for d, n, c in components_by_brute_force(rows)}, {}


def families(rng, many=6, copies=9, long=70):
    rows = []
    for _ in range(many):
        base = [rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(rng.randint(6, long))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "Z" + str(rng.randrange(9))
            rows.append((len(rows), " ".join(w)))
    return rows


#: Columns narrow, wide but for pairs, and all dealt as hot ones.
COLUMNS = [(64, 64), (1, 64), (1, 1)]


@pytest.mark.parametrize("most,hot", COLUMNS)
@pytest.mark.parametrize("ids", ["own", "null", "one", "mixed"])
def test_jaccard_classes_equal_brute_force(spark, monkeypatch, most, hot, ids):
    from rasterloom.llm import jaccard_join as j

    for name, value in (("MOST", most), ("HOT", hot), ("BLOCK", 4), ("USUAL", 20), ("SAMPLE", 1)):
        monkeypatch.setattr(j, name, value)
    rng = random.Random(9)
    rows = families(rng)
    common = " ".join(f"licence{i}" for i in range(40))  # a passage that many otherwise different documents share
    rows += [(60 + i, common + " " + " ".join(f"own{rng.randrange(10**6)}" for _ in range(rng.randint(5, 30)))) for i in range(20)]
    rows += [(100 + i, t) for i, t in enumerate(AWKWARD)] + [(200, "one two"), (201, "ONE  two"), (3, rows[3][1]), (202, "one two three"), (203, "w" + " v" * 30_000)]
    if ids == "null":
        rows = [(None, t) for _, t in rows]
    elif ids == "one":
        rows = [(5 if i % 3 == 0 else 1000 + i, t) for i, (_, t) in enumerate(rows)]
    elif ids == "mixed":
        rows = [(None if i % 3 == 0 else d % 70, t) for i, (d, t) in enumerate(rows)]
    got = j.classes(documents(spark, [t for _, t in rows], [d for d, _ in rows])).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(components_by_brute_force(rows))
    if ids == "own":
        assert j.classes(empty(spark)).count() == 0


@pytest.mark.parametrize("size", [1, 2])
def test_jaccard_sets_that_share_a_number(spark, monkeypatch, size):
    """With numbers of 8 or 16 bits many different sets have one; none of them may be taken for another."""
    from rasterloom.llm import jaccard_join as j

    monkeypatch.setattr(j, "NUMBER_BYTES", size)
    rng = random.Random(10)
    rows = families(rng, 25, 6) + [(900 + i, f"only {i} of its kind here") for i in range(300)] + [(None, "only 7 of its kind here")]
    rows += [(i, t) for i, t in rows[:9]]
    got = j.classes(documents(spark, [t for _, t in rows], [d for d, _ in rows])).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(components_by_brute_force(rows))
    docs = documents(spark, [t for _, t in rows], [d for d, _ in rows], extra=False)
    kept = {r["doc_id"] for r in j.stage(spark, docs, SF).collect()}
    assert kept == {c for _, _, c in components_by_brute_force(rows)}


def test_jaccard_null_ids(spark):
    from rasterloom.llm import jaccard_join as j

    text = "a b c d e f g h"
    got = j.classes(spark.createDataFrame([(None, text), (4, text), (None, "lonely words in a row here")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["component_id"] or -1) for r in got) == [(False, 4), (True, -1), (True, 4)]


def test_jaccard_one_id_with_two_texts(spark, monkeypatch):
    from rasterloom.llm import jaccard_join as j

    monkeypatch.setattr(j, "MOST", 1)
    a, b = "a b c d e f g h i j", "p q r s t u v w x y"
    rows = [(1, a), (1, b), (2, a + " k"), (3, b + " z"), (4, "nothing like any of the others")]
    got = j.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_jaccard_stage_loses_no_text(spark):
    from rasterloom.llm import jaccard_join as j

    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, a), (1, b), (1, a), (2, a), (None, a), (None, "x1 x2 x3 x4 x5 x6"), (None, "x1 x2 x3 x4 x5 x6"), (3, " "), (3, ""), (3, ""), (None, ""), (7, "X y"), (8, "x  Y")]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, n long")
    out = j.stage(spark, docs, SF)
    assert out.columns == docs.columns
    want = [(1, a), (1, b), (None, "x1 x2 x3 x4 x5 x6"), (3, " "), (3, ""), (None, ""), (7, "X y")]
    assert collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) == collections.Counter(want)


def test_sparse_product_counts():
    import numpy as np

    from rasterloom.llm.jaccard_join import Incidence

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    m = Incidence(sets)
    for i in range(30):
        others = rng.permutation(30)[: rng.integers(0, 30)]
        assert list(m.overlaps(i, others)) == [len(np.intersect1d(sets[i], sets[j])) for j in others]


def test_bitmap_bound_never_excludes_a_link():
    import numpy as np

    from rasterloom.llm.jaccard_join import least_overlap, may_link, parity

    rng = np.random.default_rng(4)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 40, rng.integers(1, 400)).astype(np.uint64))
        keep = a[rng.random(len(a)) < rng.uniform(0.6, 1)]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 40, rng.integers(0, 60)).astype(np.uint64)]))
        if len(b) and len(np.intersect1d(a, b)) >= least_overlap(len(a) + len(b)):
            assert may_link(len(a), parity(a), len(b), parity(b))


def test_language_id_on_held_out_documents(spark):
    from rasterloom.llm.language_id import dictionaries, languages, op7_language_id

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.95 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    got = by_id(languages(documents(spark, [None, "", "123 !?", "the and of"]), {"en": b"the and of", "fr": b"les des une"}))
    assert [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and got[3]["lang_pred"] == "en"
    assert dictionaries(empty(spark)) == {} and languages(empty(spark), {}).count() == 0


def test_language_id_equals_brute_force(spark):
    """Each text compressed with each dictionary by a compressor of its own; the smallest wins."""
    import zstandard

    from rasterloom.llm.language_id import LEVEL, dictionaries, languages

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dicts = dictionaries(docs)
    texts = corpus(spark) + ["½", "²①Ⅷ", "٣٤", "½ a", "ª", "ʰ", "ー", "naïve " * 30_000, "der die das " * 50_000]
    got = by_id(languages(documents(spark, texts), dicts))
    for i, t in enumerate(texts):
        import unicodedata

        letter = any(unicodedata.category(c).startswith("L") for c in t or "")
        sizes = []
        for lang in sorted(dicts):
            d = zstandard.ZstdCompressionDict(dicts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append((len(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False).compress((t or "").encode())), lang))
        sizes.sort()
        if not letter:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0), t
        else:
            lead = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
            assert got[i]["lang_pred"] == sizes[0][1] and abs(got[i]["score"] - min(1, 10 * lead)) < 1e-12, t[:50]


def test_language_id_defined_results(spark, monkeypatch):
    from rasterloom.llm import language_id as g

    same = {"bb": b"one text", "aa": b"one text"}
    rows = g.languages(documents(spark, ["one text here", "one text here"], [1, 1]), same).collect()
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in rows] == [("aa", 0.0, True)] * 2  # a tie, repeated
    (one,) = g.languages(documents(spark, ["any"]), {"xx": b"some words"}).collect()
    assert (one["lang_pred"], one["score"]) == ("xx", 1.0)
    (none,) = g.languages(documents(spark, ["any"]), {}).collect()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)
    # whole texts fill a dictionary; a language of long texts only is learned from one; equal rows count once
    long = "long words " * 20_000
    docs = [(i, f"text {i} of one language", "aa") for i in range(40)] + [(100, long, "bb"), (101, long, "bb"), (102, None, "cc"), (103, "x", None)]
    docs += [(None, "no id at all", "aa")] * 50
    made = g.dictionaries(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert set(made) == {"aa", "bb"} and made["aa"].count(b"no id at all") == 1 and 1000 < len(made["bb"]) <= g.DICT_BYTES + 1
    learned = made["aa"].decode().splitlines()
    assert set(learned) <= {t for _, t, _ in docs if t} and len(set(learned)) == len(learned) > 20
    monkeypatch.setattr(g, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        g.dictionaries(spark.createDataFrame(docs, "doc_id long, text string, lang string"))


def test_language_id_loses_no_language(spark):
    """Languages of long texts, of short ones, of one empty text: every one gets a dictionary, whatever the draw."""
    from rasterloom.llm import language_id as g

    rows = [(100 * k + i, f"word{k} " * 12_000, f"long{k:02}") for k in range(30) for i in range(12)]
    rows += [(10_000 + 100 * k + i, f"short text {i} of {k}", f"short{k}") for k in range(5) for i in range(40)]
    rows += [(20_000 + i, "", "empty") for i in range(9)] + [(30_000 + i, f"{i} " * 30_000 if i % 2 else f"few {i}", "mixed") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).cache()
    made = g.dictionaries(docs)
    assert set(made) == {lang for *_, lang in rows}
    assert all(len(d) > g.DICT_BYTES // 2 for lang, d in made.items() if lang.startswith("long"))
    assert made["mixed"].startswith(b"few") and b"29 29" not in made["mixed"]
    held = {r["doc_id"] for r in docs.filter(g.held_out()).collect()}
    for k in range(5):
        assert made[f"short{k}"].count(b"\n") == sum(1 for i, _, lang in rows if lang == f"short{k}" and i not in held)
    got = g.languages(spark.createDataFrame([(1, "word7 word7 word7"), (2, "word29 word29 word29")], "doc_id long, text string"), made).collect()
    assert {r["lang_pred"] for r in got} == {"long07", "long29"}
    docs.unpersist()


def test_sharding_table_equals_a_plain_filling():
    """Turns taken slot by slot, each shard walking its own permutation from its start."""
    from rasterloom.llm.sharding import SHARDS, TABLE_SIZE, lookup_table

    for shards, size in ((SHARDS, TABLE_SIZE), (("a", "b", "c"), 7), (("x",), 2), (("p", "q", "r", "s", "t"), 5)):
        walks = []
        for name in shards:
            digest = hashlib.md5(name.encode()).hexdigest()
            offset, stride = int(digest[:16], 16) % size, int(digest[16:], 16) % (size - 1) + 1
            walks.append(iter([(offset + k * stride) % size for k in range(size)]))
        table = {}
        while len(table) < size:
            for k, walk in enumerate(walks):
                if len(table) < size:
                    table[next(s for s in walk if s not in table)] = k
        assert lookup_table(shards, size) == [table[s] for s in range(size)]


def test_sharding_takes_any_columns(spark):
    from rasterloom.llm.sharding import placed

    df = spark.createDataFrame([(1, 5, "x"), (None, 6, None)], "doc_id long, _slot int, _shard string")
    out = placed(df)
    assert out.columns == ["doc_id", "_slot", "_shard"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["_shard"].startswith("shard-") and rows[None]["_shard"].startswith("shard-")
    assert placed(df, key="_slot").columns == out.columns and placed(df.limit(0)).count() == 0


def test_sharding_table_is_even_and_stable(spark):
    from rasterloom.llm.sharding import SHARDS, TABLE_SIZE, lookup_table, placed

    t = lookup_table()
    n = collections.Counter(t)
    assert len(t) == TABLE_SIZE and len(n) == len(SHARDS) and max(n.values()) - min(n.values()) <= 1
    fewer = lookup_table(SHARDS[:-1])
    moved = sum(SHARDS[a] != SHARDS[b] for a, b in zip(t, fewer))
    assert moved < 0.1 * TABLE_SIZE  # a lost shard moves little else
    rows = placed(documents(spark, ["a", "b", None], [1, 1, None])).collect()
    assert len(rows) == 3 and len({r["_shard"] for r in rows if r["doc_id"] == 1}) == 1
    with pytest.raises(ValueError):
        lookup_table(SHARDS, 16380)


@pytest.mark.parametrize("block_words", [400_000, 12])
def test_decontamination_equals_brute_force(spark, monkeypatch, block_words):
    from rasterloom.llm import decontamination as w

    monkeypatch.setattr(w.blocks, "__defaults__", (block_words,))
    rng = random.Random(1)
    words = ["a", "B", "c", "é", "9"]
    item = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, item(rng.choice([1, 2, 3, 5, 10, 12, 14, 40]))) for i in range(12)] + [(50, None), (51, "!!"), (3, "a a a a"), (None, "a b c a"), (None, "9 9 9"), (70, items70 := item(25)), (71, items70)]
    texts = [item(rng.randint(0, 60)) for _ in range(30)] + [items[4][1] + ", x " + items[7][1], *AWKWARD, items70, item(3000), "x " * 100_000 + items70]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as _hit")
    got = by_id(w.occurrences(documents(spark, texts), bench))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for i, t in enumerate(texts):
        ws, hit, found = split(t), set(), set()
        for k, x in items:
            p = split(x)
            n = min(10, len(p))
            windows = {tuple(p[s : s + n]) for s in range(len(p) - n + 1)} if n else set()
            for at in range(len(ws) - n + 1) if n else ():
                if tuple(ws[at : at + n]) in windows:
                    hit.update(range(at, at + n))
                    found.add(k)
        listed = ",".join(sorted(str(k) for k in found if k is not None))  # an item without id counts, unnamed
        want = (len(ws), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit))
        assert tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want, i
    assert w.occurrences(empty(spark), bench).count() == 0
    assert {r["n_hit"] for r in w.occurrences(documents(spark, texts), bench.limit(0)).collect()} == {0}


def test_decontamination_of_repeated_windows():
    """Equal windows, of one item or of many, and different ones with one end, cost one look-up each."""
    import time

    from rasterloom.llm.decontamination import Matcher

    a = b"a"
    many = [(i, [b"one", b"two", *[b"%d" % (i if i % 2 else 0)], *[b"x"] * 9]) for i in range(30_000)]
    for items, words in (([(1, [a] * 20_000), (2, [a] * 10), (3, [b"b"] * 12)], [a] * 2000), (many, [b"0"] + [b"x"] * 2000)):
        began = time.perf_counter()
        m = Matcher(items)
        built = time.perf_counter() - began
        hit, found = bytearray(len(words)), set()
        m.search(words, hit, found)
        assert time.perf_counter() - began - built < 1 and built < 5
        if len(items) == 3:
            assert found == {"1", "2"} and sum(hit) == 2000
        else:  # ten words from a 0 on are of the even items
            assert found == {str(i) for i in range(0, 30_000, 2)} and sum(hit) == 10


def test_decontamination_matcher_is_bounded_by_words():
    import tracemalloc

    from rasterloom.llm.decontamination import Matcher

    rng = random.Random(2)
    words = [f"w{rng.randrange(40_000)}".encode() for _ in range(100_000)]
    items = [(i, words[i * 100 : i * 100 + 100]) for i in range(1000)]
    tracemalloc.start()
    m = Matcher(items)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 400 * len(words)
    hit, found = bytearray(100), set()
    m.search(items[7][1], hit, found)
    assert found == {"7"} and sum(hit) == 100


def test_bpe_equals_the_library(spark):
    import numpy as np
    from tokenizers import Tokenizer

    from rasterloom.llm.bpe_codec import default_vocabulary, decoded, encoded, round_trips

    t = Tokenizer.from_file(default_vocabulary())
    texts = corpus(spark) + ["ΑΣ Σ", "İx", "a½²³", "don't we'll", "__a_b", "e\u0301", "\u00a0x\u2003y"]
    docs = documents(spark, texts)
    ids, trips = by_id(encoded(docs)), by_id(round_trips(docs))
    back = by_id(decoded(encoded(docs)))
    for i, x in enumerate(texts):
        e = t.encode(x or "", add_special_tokens=False).ids
        want = np.array(e, "<u4").tobytes()
        text = t.decode(e, skip_special_tokens=False)
        assert bytes(ids[i]["ids"]) == want and ids[i]["n_tokens"] == len(e), i
        assert back[i]["text"] == text
        assert (trips[i]["ids_sha256"], trips[i]["decoded_sha256"]) == (hashlib.sha256(want).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert encoded(empty(spark)).count() == 0


def test_bpe_plain_characters_agree_with_the_library():
    from tokenizers import Tokenizer

    from rasterloom.llm.bpe_codec import codec, default_vocabulary

    c, t = codec(default_vocabulary()), Tokenizer.from_file(default_vocabulary())
    for cp in [*range(0x250), *range(0x2000, 0x2070), 0x20AC]:
        for x in (f"a{chr(cp)}b", f"1{chr(cp)}!"):
            assert [int.from_bytes(c.encode(x)[k : k + 4], "little") for k in range(0, len(c.encode(x)), 4)] == t.encode(x, add_special_tokens=False).ids, hex(cp)
