"""The whole pipeline against plain Python: only the verdict of the quality rules is taken from its operator."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from ebbtide.llm import bpe, quality, stages
from tests.llm.conftest import some_text
from tests.llm.test_documents import hits_by_hand
from tests.llm.test_repeats import lines_by_hand, linked_by_hand


def planted(rnd):
    """Documents with common blocks, near and exact copies, benchmark passages, noise, and odd rows; and the benchmark."""
    bench = [(1, some_text(rnd, 40, 40, 99)), (2, some_text(rnd, 10, 10))]
    rows = [(i, some_text(rnd, 60, 200)) for i in range(60)]
    block = some_text(rnd, 30, 30)
    rows += [(100 + i, "\n".join([some_text(rnd, 40, 60), block, some_text(rnd, 40, 60)])) for i in range(6)]
    rows += [(200, rows[3][1]), (201, " ".join(rows[4][1].split()[:-1] + ["changed"])), (202, rows[5][1].replace("\n", " "))]
    rows += [(300, some_text(rnd, 40, 50) + " " + " ".join(bench[0][1].split()[7:25]) + " " + some_text(rnd, 40, 50)), (301, bench[1][1] + "\n" + some_text(rnd, 60, 80))]
    rows += [(400, "".join(chr(rnd.randint(33, 126)) + rnd.choice(["", "", "", " "]) for _ in range(1500))), (401, None), (402, ""), (403, "too short")]
    rnd.shuffle(rows)
    return rows, bench


def test_pipeline_against_plain_python(spark, tmp_path):
    rows, bench = planted(random.Random(21))
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r.doc_id for r in quality.assess(docs).where("kept").collect()}
    assert not {400, 401, 402, 403} & kept and len(kept) > 60
    left = {k: text for (k, _), (_, _, text) in lines_by_hand([r for r in rows if r[0] in kept]).items() if text.strip()}
    assert sum(left[k] != t for k, t in rows if k in left) >= 5
    near = {r[0] for r in linked_by_hand(sorted(left.items()), 5, 80) if r[3]}
    assert 202 not in near and len(near) < len(left)
    hit = {h[0] for h in hits_by_hand([(k, left[k]) for k in near], bench, 10) if h[-1]}
    assert hit >= {300, 301} & near and hit
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load(P.path(stages.BPE_RANKS), P.PATTERN).ranks, special_tokens={})
    want = {}
    for k in near - hit:
        ids = np.array(library.encode_ordinary(left[k]), "<u4").tobytes()
        want[k] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(left[k].encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
