"""Code of tasks travels by value: it runs in a process that does not have the package."""

import os
import subprocess
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import cloudpickle

from lorekeep.llm import collisions, divergence, fingerprint, ngram_join, packing, phrases, pii, repeats, token_files, toxicity

BYTE = public_tokenizers.path("byte_bpe_50k.json")
TEXT = "one two three four five six seven, St00pid words! mail a.b@c.org " * 20

RUNNER = """
import pickle, sys
work = pickle.load(sys.stdin.buffer)
assert not [m for m in sys.modules if m.startswith("lorekeep")]
for name, (call, arguments, stream) in work.items():
    try:
        out = call(*([iter(a) for a in arguments] if stream else arguments))
        if stream:
            out = list(out)
    except Exception as error:
        raise RuntimeError(name) from error
    assert out is not None, name
assert not [m for m in sys.modules if m.startswith("lorekeep")]
print("done", len(work))
"""


def batch(**columns):
    return [pa.record_batch(columns)]


def test_shipped_code_needs_no_package(tmp_path):
    texts = [TEXT, TEXT + "x", None, ""]
    ids = pa.array([1, 2, 3, 4], pa.int64())
    text = pa.array(texts, pa.string())
    log_p = toxicity.Language({5: 3, 77: 1}).log_p
    model = toxicity.Model(log_p, {"stupid": 3.0}, (-1.0, 1.0, 0.0))
    handed = list(ngram_join.hand_out(2)(iter(batch(text=text))))
    handed[0] = handed[0].take(pa.array(np.argsort(handed[0].column("bucket").to_numpy())))
    keys = list(repeats.hand_out(2, 50)(iter(batch(text=text))))
    keys[0] = keys[0].take(pa.array(np.argsort(keys[0].column("bucket").to_numpy())))
    vectors = pa.table({"size": [2] * 3, "block": [0] * 3, "part": [0] * 3, "row": [0, 1, 2], "vec_id": [0, 1, 2], "embedding": [[1.0, 0], [0, 1.0], [1, 1.0]], "norm": [1.5] * 3})
    rows = {
        "fingerprint.compare_stream": (fingerprint.compare_stream, [batch(doc_id=ids, text=pa.array([t or "" for t in texts]), block=[0] * 4, guest=[0, 0, 0, 1])], True),
        "ngram_join.describe": (ngram_join.describe, [batch(doc=ids, hash=ids, text=text)], True),
        "ngram_join.hand_out": (ngram_join.hand_out(2), [batch(text=text)], True),
        "ngram_join.settle_buckets": (ngram_join.settle_buckets(2), [handed], True),
        "ngram_join.sets_of": (ngram_join.sets_of(np.full(8, 255, dtype=np.uint8)), [batch(doc=ids, text=text, slot=ids)], True),
        "toxicity.count_trigrams": (toxicity.count_trigrams, [batch(text=text)], True),
        "toxicity.counted_features": (toxicity.counted_features(log_p), [batch(text=text, toxic=[0, 1, 0, 1])], True),
        "toxicity.evidence_rows": (toxicity.evidence_rows(model), [batch(text=text, toxic=[0, 1, 0, 1])], True),
        "repeats.hand_out": (repeats.hand_out(2, 50), [batch(text=text)], True),
        "repeats.settle_buckets": (repeats.settle_buckets, [keys], True),
        "repeats.cut_segments": (repeats.cut_segments(50), [batch(sha=["a"] * 4, text=text, tokens=[[1, 2]] * 4)], True),
        "token_files.encode_rows": (token_files.encode_rows(BYTE, 1, [2]), [batch(doc_id=ids, text=text)], True),
        "pii.spans_of": (pii.spans_of, [TEXT, 0.5], False),
        "pii.masked": (pii.masked, [TEXT, 0.5], False),
        "packing.cut": (packing.cut, [700, 2048], False),
        "divergence.partial_counts": (divergence.partial_counts, [batch(lang=["en"] * 4, source=["a", "b"] * 2, text=pa.array([t or "" for t in texts]))], True),
        "divergence.diverge": (divergence.diverge(5), [shard()], False),
        "collisions.build": (collisions.build(8), [vectors], False),
        "collisions.gather": (collisions.gather, [vectors], False),
        "phrases.occurrences": (phrases.occurrences, [[TEXT, ""]], False),
    }
    payload = cloudpickle.dumps(rows)
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUNNER], input=payload, cwd=tmp_path, env=clean, capture_output=True, timeout=120)
    assert done.stdout.decode().strip() == f"done {len(rows)}", done.stderr.decode()[-2000:]


def shard():
    head = {"lang": "en", "one": 0, "two": 0, "shard": 0, "n_terms": 1, "lang_total": 3, "n": 0, "n_lang": 0}
    heads = [head | {"place": k, "source": s, "total": n, "term": None} for k, (s, n) in enumerate((("a", 1), ("b", 2)))]
    rows = [head | {"place": k, "source": None, "total": n, "term": "x", "n": n, "n_lang": 3} for k, n in enumerate((1, 2))]
    return pa.Table.from_pylist(heads + rows, schema=pa.schema([("lang", pa.string()), *[(c, pa.int64()) for c in ("one", "two", "shard", "n_terms", "lang_total", "n", "n_lang", "place")], ("source", pa.string()), ("total", pa.int64()), ("term", pa.string())]))

