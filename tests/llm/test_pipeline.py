"""The pipeline's stages, and its rows, against plain versions of them."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corvid.llm import pii, similar
from corvid.llm.queries import WORD_BPE, pii_key

from test_whole import plain_replacement, varied

# columns with the names of the operators' own
EXTRA = "lang_found has_letter gone_ uid row found known h digest norm fp keys node n sig __hot component_id kept sur v group_size piece".split()


def documents(spark):
    rnd = random.Random(12)
    texts = varied(8, groups=15, copies=4) + ["12 34 !!", "²½", None, " "]
    texts += [t.upper() for t in texts[:9]] + texts[20:24] * 2
    texts += [f"write to {i}@mail{i % 3}.example.com or +1 (555) 123 {1000 + i % 4} from 10.0.{i}.{i} at once" for i in range(12)]
    rnd.shuffle(texts)
    ids = rnd.sample(range(10_000), len(texts))
    rows = [(i, t, rnd.choice(["en", None]), "s", len(t or "") or None, *["x"] * len(EXTRA)) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA))


def plain_near(kept):
    """All pairs of fingerprints; of these texts, those that agree are linked over pairs that share four fifths of their shingles."""
    ids = sorted(kept)
    fp = np.stack([np.frombuffer(similar.wide_fingerprint(similar.shingles(kept[i].encode())), np.uint64) for i in ids])
    up = list(range(len(ids)))
    for i, j in np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) <= 51, 1)).tolist():
        up = [up[i] if u == up[j] else u for u in up] if up[i] < up[j] else [up[j] if u == up[i] else u for u in up]
    return {ids[k]: kept[ids[k]] for k in sorted(set(up))}


def test_stages_against_plain_versions(spark, tmp_path):
    import corpus_pipeline as C

    docs = documents(spark)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    exp = {r["doc_id"]: r["text"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    groups = {}
    for i, t in exp.items():
        groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t), []).append(i)
    after = {"language": exp, "exact_dedup": {max(g): exp[max(g)] for g in groups.values()}}
    after["near_dedup"] = plain_near(after["exact_dedup"])
    _, table = pii.replace(spark.createDataFrame(list(after["near_dedup"].items()), "doc_id long, text string"), pii_key(spark))
    new = {(r["kind"], r["canon"]): r["sur"] for r in table.collect()}
    after["pii"] = {i: plain_replacement(t, new) for i, t in after["near_dedup"].items()}
    sizes = [len(exp), *(len(after[n]) for n in ("exact_dedup", "near_dedup"))]
    assert sizes[0] > sizes[1] > sizes[2] > 15 and after["pii"] != after["near_dedup"]
    kept = docs
    for name, stage in C.STAGES[:-1]:
        kept = stage(spark, kept, f"file://{tmp_path}")
        assert kept.columns == docs.columns
        assert {r["doc_id"]: r["text"] for r in kept.collect()} == after[name], name
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())
    lib = Tokenizer.from_file(WORD_BPE)
    ids = {i: lib.encode(t, add_special_tokens=False).ids + [1] for i, t in after["pii"].items()}
    out = C.run(spark, f"file://{tmp_path}").collect()
    pieces = [(i, n, 4096 * n, len(x[4096 * n : 4096 * (n + 1)]), zlib.crc32(np.array(x[4096 * n : 4096 * (n + 1)], "<u4").tobytes())) for i, x in ids.items() for n in range(-(-len(x) // 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(pieces)
    assert len({r["sequence_id"] for r in out}) == -(-sum(map(len, ids.values())) // 4096)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)]])
def test_empty_tables_and_null_rows(spark, tmp_path, rows):
    import corpus_pipeline as C

    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert C.run(spark, f"file://{tmp_path}").count() == 0
