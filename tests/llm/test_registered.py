"""The registered queries over a small fixture, against brute force; the pipeline, stage by stage."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from folioforge.llm import common, licenses, quality, queries
from test_operators import ALNUM, base_spans, classes, contaminated, expected_ids, slow_fingerprint, slow_templates, whole, words


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    """Documents with near and exact copies, benchmark passages, secrets, license lines, junk, null and empty texts."""
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéß"), rng.integers(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n)).capitalize()
    items = [prose(30) for _ in range(12)] + ["short item here", None, ""]
    texts: list = [prose(int(rng.integers(25, 400))) + ".\n" + prose(40) for _ in range(60)]
    texts += [texts[i] for i in (3, 3, 5)] + [texts[7] + " once", texts[8].replace(" ", "  "), None, "", "a", " \n"]
    texts += [prose(60) + " " + items[k] + " " + prose(20) for k in range(6)] + [prose(900) + " " + items[7][:120]]
    texts += [prose(30) + "\npassword=" + "0a1b2c" * 5 + " " + prose(20), "token: 'abcdefgh' AKIA" + "Z" * 16 + " " + prose(25), prose(25) + "\nLicensed under the Apache License, Version 2.0.", "MIT license. " + prose(30)]
    texts += [prose(30) + "\n" + whole(m) + prose(5) for _, m in licenses.LICENSES[:5]] + [prose(40) + "\n" + whole(m)[:300] for _, m in licenses.LICENSES[3:9]] + ["all rights were given to them, all " + prose(30), "license " + prose(30) + " all of us"]
    texts += [" ".join(w + "###" for w in rng.choice(vocabulary, 80)) for _ in range(12)] + ["same words again and again and then more " * 12]
    texts += ["a <|endoftext|> b " + prose(30), prose(25) + "<|startoftext|><|endoftext|>"]
    n = len(texts)
    base = tmp_path_factory.mktemp("sf")
    put = lambda name, **cols: pq.write_table(pa.table(cols), f"{base}/{name}.parquet")
    put("documents", doc_id=pa.array(range(n), pa.int64()), text=pa.array(texts), lang=pa.array(["xx"] * n), source=pa.array([f"s{i % 3}" for i in range(n)]), n_chars=pa.array([None if t is None else len(t) for t in texts], pa.int64()))
    put("labels", doc_id=pa.array(range(n), pa.int64()), quality=pa.array([0 if "###" in (t or "") else 1 for t in texts], pa.int32()), toxic=pa.array([0] * n, pa.int32()))
    ids = [*range(len(items) - 1), None]
    items[-1] = " ".join(texts[20].split()[2:40])  # an item without an id hits words and is not listed
    put("benchmark", item_id=pa.array(ids, pa.int64()), text=pa.array(items))
    put("pages", page_id=pa.array(range(n), pa.int64()), url=pa.array(["u"] * n), html=pa.array([None if t is None else f"<nav>menu</nav><article><p>{t}</p></article><footer>f</footer>" for t in texts]))
    conv = [(i // 3, i % 3, ("user", "assistant", None)[i % 3], t) for i, t in enumerate(texts)]
    put("conversations", **{k: pa.array([c[j] for c in conv], t) for j, (k, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))})
    return str(base), list(enumerate(texts)), list(zip(ids, items)), conv


def result(spark, sf, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, sf[0]).collect()]


sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_op1(spark, sf):
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in result(spark, sf, "op1_html_extraction")}
    assert got == {k: (x := " ".join((t or "").split()), len(x)) for k, t in sf[1]}


def test_op2(spark, sf):
    got = result(spark, sf, "op2_packing")
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, t in sf[1]:
        ids, at = expected_ids(t, "byte_bpe_50k.json", 0), 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for spans in by_seq.values():
        assert [o for o, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1].tolist()]
    tokens = sum(r["length"] for r in got)
    assert 1024 * len(by_seq) < 1.08 * tokens  # a hundred documents: hardly any choice of rests


def test_op3(spark, sf):
    want = {(k, n, h, len(f), sha(",".join(sorted(map(str, f)))), h > 0 and 20 * h >= n) for k, n, h, f in contaminated(sf[1], sf[2])}
    assert {tuple(r.values()) for r in result(spark, sf, "op3_decontamination")} == want and any(x[-1] for x in want)


def test_op4(spark, sf):
    pairs = [(k, slow_fingerprint(t)) for k, t in sf[1]]
    want = {(k, f"{p:016x}", c) for (k, p), c in zip(pairs, classes(pairs))}
    assert {tuple(r.values()) for r in result(spark, sf, "op4_simhash")} == want and len({c for *_, c in want}) < len(want)


def test_op5(spark, sf):
    want, at = set(), 0
    for k, t in sf[1]:
        ids = expected_ids(t, "word_bpe_49k.json", 1)
        want.add((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {tuple(r.values()) for r in result(spark, sf, "op5_token_store")} == want


def test_op6(spark, sf):
    names = ("assign", "access", "hex")
    want = set()
    for k, t in sf[1]:
        s = base_spans(t)
        want.add((k, *(sum(x[1] == i for x in s) for i in range(3)), sha(",".join(f"{names[b]}:{a}:{c}" for a, b, c in s))))
    got = result(spark, sf, "op6_secrets")
    assert {tuple(r.values())[:5] for r in got} == want
    assert all(f"{names[b]}:{a}:{c}" in r["spans"].split(",") for r in got for a, b, c in base_spans(dict(sf[1])[r["doc_id"]]))


def stats(t):
    w, windows = words(t, low=False), {}
    lines = [x for x in (t or "").split("\n") if words(x)]
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    cover = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover)


def test_op7(spark, sf):
    want = {(k, *(s := stats(t)), s[0] < 20 or 100 * s[4] > 30 * s[0]) for k, t in sf[1]}
    got = result(spark, sf, "op7_quality_rules")
    assert {tuple(r.values())[:7] for r in got} == want
    assert all(not r["kept"] for r in got if r["base_failed"])
    text = dict(sf[1])
    assert all(r["kept"] == ("###" not in (text[r["doc_id"]] or "")) for r in got if not r["base_failed"])


def test_op8(spark, sf):
    tok = {k: words(t) + [None] for k, t in sf[1]}
    out = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tok}
    c = Counter(x for k in tok if not out[k] for x in tok[k])
    total, norm = sum(c.values()), math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
    for r in result(spark, sf, "op8_lm_scoring"):
        t = tok[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(t), sum(c[x] > 0 for x in t), total)
        assert abs(r["base_score"] - sum(math.log10(c[x] + 0.5) - norm for x in t)) < 1e-6 and r["score"] < 0


def test_op9(spark, sf):
    said = "<|im_end|><|im_start|>assistant ok"
    want = {}
    for c, _, role, text in [*sf[3], (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        want.setdefault(c, []).append((role or "", text or ""))
    for r in result(spark, sf, "op9_chat_format"):
        turns = want.pop(r["conv_id"])
        learned = "".join(x for role, x in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(learned), sha(learned))
    assert not want


def test_op10(spark, sf):
    want = set()
    for k, t in sf[1]:
        w = words(t, ALNUM)
        at = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        want.add((k, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = result(spark, sf, "op10_license_scan")
    assert {tuple(r.values())[:6] for r in got} == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert any("apache-2.0" in r["labels"] for r in got)
    text = dict(sf[1])
    for r in got:
        found, score = slow_templates(words(text[r["doc_id"]], ALNUM))
        assert set(filter(None, r["labels"].split(","))) == found | set(filter(None, r["base_labels"].split(","))) and abs(r["score"] - score) < 1e-12


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontamination", "secret_scan", "packing"]
    docs = queries.table(spark, sf[0], "documents")
    columns, kept = docs.columns, dict(sf[1])
    rules = quality.learn_rules(docs, queries.table(spark, sf[0], "labels"))
    verdict = {r["key"]: r["v"] for r in quality.statistics(docs).select("key", quality.verdict(rules).alias("v")).collect()}
    expected = []
    kept = {k: t for k, t in kept.items() if (s := stats(t))[0] >= 20 and 100 * s[4] <= 30 * s[0] and verdict[k]}
    expected.append(kept)
    group = dict(zip(kept, classes([(k, slow_fingerprint(t)) for k, t in kept.items()])))
    kept = {k: t for k, t in kept.items() if group[k] == k}
    expected.append(kept)
    bad = {k for k, n, h, _ in contaminated(list(kept.items()), sf[2]) if h and 20 * h >= n}
    kept = {k: t for k, t in kept.items() if k not in bad}
    expected.append(kept)
    masked = {}
    for k, t in kept.items():
        out, at = "", 0
        for a, _, b in base_spans(t):
            if a > at or not at:
                out += t[at:a] + "[REDACTED]"
            at = max(at, b)
        masked[k] = out + t[at:]
    expected.append(masked)
    assert len({len(e) for e in expected[:3]}) == 3 and masked != kept
    for (_, apply), want in zip(corpus_pipeline.STAGES[:-1], expected):
        docs = corpus_pipeline.stage(apply(spark, docs, sf[0]), "test")
        assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == want
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    got = {}
    for r in corpus_pipeline.run(spark, sf[0]).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    assert {k: b"".join(x for _, x in sorted(v)) for k, v in got.items()} == {k: np.array(expected_ids(t, "byte_bpe_50k.json", 0), "<u4").tobytes() for k, t in masked.items()}


@pytest.fixture(scope="module")
def odd(sf, tmp_path_factory):
    """The documents with columns that the operators use for themselves, null ids, and every fifth row again."""
    base = tmp_path_factory.mktemp("odd")
    texts = dict(sf[1])
    given = [(k, t) for k, t in sf[1]] + [(k, texts[k]) for k in list(texts)[::5]] + [(None, texts[3] + " no id"), (None, None), (None, "with an id of none " * 30 + "password=abcdef123")]
    n = len(given)
    extra = {c: pa.array([c] * n) for c in ("key", "hash", "text_hash", "row", "found", "_cut", "_key", "c0", "spans", "n_words", "kind")}
    pq.write_table(pa.table({"doc_id": pa.array([k for k, _ in given], pa.int64()), **extra, "text": pa.array([t for _, t in given]), "fp": pa.array(range(n)), "component_id": pa.array(range(n))}), f"{base}/documents.parquet")
    for name in ("labels", "benchmark"):
        pq.write_table(pq.read_table(f"{sf[0]}/{name}.parquet"), f"{base}/{name}.parquet")
    return str(base), given


def test_pipeline_of_odd_tables(spark, sf, odd, tmp_path):
    docs = queries.table(spark, odd[0], "documents")
    columns, steps = docs.columns, []
    for _, apply in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(apply(spark, docs, odd[0]), "odd")
        assert docs.columns == columns
        steps.append([(r["doc_id"], r["text"], r["found"]) for r in docs.collect()])
    rules = quality.learn_rules(queries.table(spark, odd[0], "documents"), queries.table(spark, odd[0], "labels"))
    verdict = {r["key"]: r["v"] for r in quality.statistics(queries.table(spark, sf[0], "documents")).select("key", quality.verdict(rules).alias("v")).collect()}
    good = [(k, t) for k, t in odd[1] if (s := stats(t))[0] >= 20 and 100 * s[4] <= 30 * s[0] and (k is None or verdict[k])]
    assert sorted((k, t) for k, t, _ in steps[0] if k is not None) == sorted((k, t) for k, t in good if k is not None)
    group = classes([(k, slow_fingerprint(t)) for k, t, _ in steps[0]])
    assert len(steps[1]) == len({g if g is not None else ("none", slow_fingerprint(t)) for g, (_, t, _) in zip(group, steps[0])})  # one of each group, repeated rows too
    assert {k for k, _, _ in steps[1] if k is not None} == {g for g in group if g is not None}
    bad = [h > 0 and 20 * h >= n for _, n, h, _ in contaminated([(i, t) for i, (_, t, _) in enumerate(steps[1])], sf[2])]
    assert sorted(x[1] for x in steps[2]) == sorted(x[1] for x, b in zip(steps[1], bad) if not b)
    assert len(steps[3]) == len(steps[2]) and all("password=0a" not in t and "password=abcdef123" not in t for _, t, _ in steps[3])
    packed = corpus_pipeline.run(spark, odd[0])
    assert sum(r["length"] for r in packed.collect()) == sum(len(expected_ids(t, "byte_bpe_50k.json", 0)) for _, t, _ in steps[3])
    # and without any row
    for name in ("documents", "labels", "benchmark"):
        pq.write_table(pq.read_table(f"{odd[0]}/{name}.parquet").slice(0, 0), f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_staged_tables_are_cleared(spark):
    kept = common.stage(spark.range(3), "cleared")
    assert kept.count() == 3 and common.clear(spark) >= 1 and common.clear(spark) == 0
    with pytest.raises(Exception):
        kept.select("id").collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    """Null, empty and odd texts in a second engine."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf[0]}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf[0])
    cols = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = con.sql(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=key) == sorted(want, key=key)


TABLES = "/root/testdata"


@pytest.mark.skipif(not __import__("os").path.isdir(f"{TABLES}/sf0.1"), reason="no test tables")
def test_the_model_beats_the_unigram_on_held_out_text(spark):
    from pyspark.sql import functions as F

    got = queries.op8_lm_scoring(spark, f"{TABLES}/sf0.1").where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert got["s"] > 0.96 * got["b"] > got["b"]  # both are negative: log10 of probabilities


@pytest.mark.skipif(not __import__("os").path.isdir(f"{TABLES}/sf0.01"), reason="no test tables")
def test_no_link_of_the_tables_is_lost(spark):
    """Every document whose id is divisible by 20 against all: fingerprints within four bits are in one component."""
    rows_ = queries.op4_simhash(spark, f"{TABLES}/sf0.01").collect()
    fp = np.array([int(r["fingerprint"], 16) for r in rows_], np.uint64)
    group, met = [r["component_id"] for r in rows_], 0
    for i, r in enumerate(rows_):
        if r["doc_id"] % 20 == 0:
            near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4)
            met += len(near) - 1
            assert {group[j] for j in near.tolist()} == {group[i]}
    assert met > 0
