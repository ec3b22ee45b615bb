"""Every stage of the pipeline on a small folder of tables, against plain loops."""

import random

import numpy as np



import corpus_pipeline as cp
from tests.llm import test_line_dedup, test_ngram_join
from tidemark.llm import packing
from tidemark.llm.vocab import encoder, vocabulary


def tables():
    rng = random.Random(6)
    word = lambda: rng.choice("bcdfg") + rng.choice("aeiou") + str(rng.randrange(40))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(30)) for i in range(5)]
    docs, toxic, leaked = [], set(), set()
    passage = prose(60)
    for d in range(300):
        text = prose(rng.randrange(20, 120))
        if d % 7 == 0:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "foul", "nasty"]))
            text = " ".join(words)
            toxic.add(d)
        elif d % 11 == 0:
            text += "\n" + items[d % 5][1] + " tail"
            leaked.add(d)
        elif d % 5 == 0:
            text += f"\n{passage}\n{prose(8)}"
        elif d % 13 == 0 and docs:
            text = " ".join(x for x in docs[d - 6][1].split() if x not in ("vile", "foul", "nasty"))
        docs.append((d, text))
    docs += [(1000, None), (1001, ""), (None, prose(30)), (1002, docs[1][1])]
    return docs, toxic, leaked, items


def test_stages(spark, tmp_path):
    docs, toxic, leaked, items = tables()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, 1, int(d in toxic)) for d in range(300)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    steps = dict(cp.STAGES)
    seen = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        frame = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = frame.collect()
        if name != "packing":
            assert frame.columns == columns.replace(" string", "").replace(" long", "").split(", ")
    assert list(steps) == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    pairs = lambda name: [(r.doc_id, r.text) for r in seen[name]]
    assert {r.doc_id for r in seen["toxicity"]} == {d for d, _ in docs} - toxic
    want = {d: kept for d, _, _, kept in test_line_dedup.brute(pairs("toxicity"))}
    assert {d: t or "" for d, t in pairs("line dedup")} == want
    assert all(r.n_chars == len(r.text or "") for r in seen["line dedup"])
    groups = test_ngram_join.brute(pairs("line dedup"))
    assert {r.doc_id for r in seen["n-gram Jaccard join"]} == {d for null, d, _, c in groups if not null and c == d} | {None}
    left = {r.doc_id for r in seen["n-gram Jaccard join"]}
    norm = lambda t: " ".join((t or "").lower().split())
    holds = {d for d, t in pairs("n-gram Jaccard join") if any(norm(x) in norm(t) for _, x in items)}
    assert holds and {r.doc_id for r in seen["benchmark decontamination"]} == left - holds
    enc = encoder(vocabulary("byte_bpe_50k.json"))
    got = {}
    for r in sorted(seen["packing"], key=lambda r: r.start):
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    end = np.uint32(1).tobytes()
    assert got == {d: enc.encode(t) + end for d, t in pairs("benchmark decontamination")}
    assert sum(r.length for r in seen["packing"]) == sum(len(x) // 4 for x in got.values())
    assert max(packing.TIERS) >= max(r.length for r in seen["packing"])


def test_run(spark, tmp_path):
    docs, toxic, _, items = tables()
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs[:60]]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int(d in toxic)) for d in range(60)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() > 0


def test_stages_pass_on_columns_of_any_name(spark, tmp_path):
    """Names that operators use themselves, no n_chars, repeated ids, an empty and a very long text."""
    docs, toxic, _, items = tables()
    names = "toxicity passages kept n_lines n_dropped runs key pos component_id digest profile".split()
    rows = [(d, t, *[f"{n} {d}" for n in names]) for d, t in [*docs[:40], docs[1], (9, "another text of the same id"), (2000, ""), (2001, "w " * 200_000)]]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame([(d, int(d in toxic)) for d in range(40)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for some in (rows, []):
        frame = spark.createDataFrame(some, schema)
        for k, (name, stage) in enumerate(cp.STAGES[:-1]):
            path = str(tmp_path / f"{len(some)}-{k}")
            stage(spark, frame, str(tmp_path)).write.parquet(path)
            frame = spark.read.parquet(path)
            assert frame.columns == ["doc_id", "text", *names], name
            for r in frame.collect():
                assert all(r[n] == f"{n} {r.doc_id}" for n in names), name
        assert (frame.count() > 0) == bool(some)
        assert (cp.pack(spark, frame, str(tmp_path)).count() > 0) == bool(some)
