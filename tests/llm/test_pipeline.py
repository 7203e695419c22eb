"""The pipeline against plain versions of its stages and against the operators, and the registration of its queries."""

import re
from collections import Counter

import duckdb
from tokenizers import Tokenizer

import corpus_pipeline
from test_dedup import brute_components
from tributary.llm import decontaminate, near_dups, packing, quality_rules, substring_index
from tributary.llm.queries import ORACLES, QUERIES
from tributary.llm.token_ids import tokenizer_path

D = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_apply_their_operators(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    frame = lambda r: spark.createDataFrame(sorted(r.items()), "doc_id long, text string")
    kept = {r.doc_id for r in quality_rules.quality_rules(frame(rows)).where("kept").collect()}
    rows = {i: t for i, t in rows.items() if i in kept}
    kept = {r.doc_id for r in near_dups.near_dups(frame(rows)).where("kept").collect()}
    rows = {i: t for i, t in rows.items() if i in kept}
    cut = {r.doc_id: r.kept for r in substring_index.substring_dedup(frame(rows)).where("n_removed > 0").collect()}
    rows = {i: cut.get(i, t) for i, t in rows.items() if cut.get(i, t)}
    verdict = decontaminate.contamination(frame(rows), spark.read.parquet(f"{D}/benchmark.parquet"))
    bad = {r.doc_id for r in verdict.where("contaminated").collect()}
    rows = {i: t for i, t in rows.items() if i not in bad}
    want = {(r.doc_id, r.doc_tokens) for r in packing.packed(frame(rows)).collect()}
    got = corpus_pipeline.run(spark, D)
    assert {(r.doc_id, r.doc_tokens) for r in got.collect()} == want and len(want) < docs.count()


SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(0x41, 0x5B)}


def plain_pipeline(docs, benchmark, kept):
    """Text by id that the first four stages leave, by loops over whole texts; kept: ids that the quality rules keep."""
    rows = {i: t for i, t in docs.items() if i in kept}
    rows = {i: rows[i] for (i, _, _, lead) in brute_components(sorted(rows.items())) if lead}
    split = {i: SPACED.findall(t) for i, t in rows.items()}
    seen = Counter(tuple(w[k : k + 35]) for w in split.values() for k in range(len(w) - 34))
    for i, w in split.items():
        gone = {p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        if gone:
            rows[i] = " ".join(x for p, x in enumerate(w) if p not in gone)
    rows = {i: t for i, t in rows.items() if t}
    words = lambda t: ALNUM.findall((t or "").translate(FOLD))
    windows = {tuple(w[k : k + n]) for w in map(words, benchmark) for n in [min(13, len(w))] if n for k in range(len(w) - n + 1)}
    out = {}
    for i, t in rows.items():
        w = words(t)
        hit = {p for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out[i] = t
    return out


def test_pipeline_against_plain_loops(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    kept = {i for i, k in con.execute(f"SELECT doc_id, kept FROM ({ORACLES['op6_quality_rules']})").fetchall() if k}
    docs = dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    benchmark = [t for (t,) in con.execute(f"SELECT text FROM '{D}/benchmark.parquet'").fetchall()]
    left = plain_pipeline(docs, benchmark, kept)
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    sizes = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    pieces, room = Counter(), Counter()
    for r in corpus_pipeline.run(spark, D).collect():
        assert r.doc_tokens == sizes[r.doc_id] and r.offset + r.length <= 1024
        pieces[r.doc_id] += r.length
        room[r.sequence_id] += r.length
    assert pieces == Counter(sizes) and 0 < len(left) < len(kept) < len(docs)
    assert max(room.values()) <= 1024


def test_stages_keep_columns_and_survive_edges(spark, docs, no_docs, tmp_path):
    spark.createDataFrame([(1, "w1 w2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, no_docs):
        rows = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, str(tmp_path))
            assert rows.columns == docs.columns, name
            rows.collect()
        corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).collect()
