"""Chunks of a scorer's answers: files are as many as the time asks for, and what a finished one holds is not asked again."""

from __future__ import annotations

import time

import pyarrow as pa

from curatrix.operators import scoring


def answered(folder, n, scorer, chunk=scoring.CHUNK, most=scoring.MOST_CHUNK):
    requests = [f"{k:064x}" for k in range(n)]
    batches = [pa.RecordBatch.from_pydict({"request": requests[k : k + 300], "payload": [str(int(r, 16)) for r in requests[k : k + 300]]}) for k in range(0, n, 300)]
    rows = pa.Table.from_batches(scoring._answering(scorer, folder.as_uri(), "v", chunk, most)(iter(batches))).to_pylist() if n else list(scoring._answering(scorer, folder.as_uri(), "v", chunk, most)(iter(batches)))
    assert [(r["request"], r["raw"]) for r in rows] == [(r, f"a{k}") for k, r in enumerate(requests)]
    return sorted(int(f.name.split("-")[2].removesuffix(".parquet")) for f in folder.glob("chunk-*"))


def test_quick_answers_share_files(tmp_path):
    assert answered(tmp_path, 0, lambda p: f"a{p}") == []
    sizes = answered(tmp_path, 25_000, lambda p: f"a{p}")
    assert sum(sizes) == 25_000 and len(sizes) < 100  # one for sixteen before


def test_slow_answers_are_kept_by_sixteen(tmp_path, monkeypatch):
    monkeypatch.setattr(scoring, "SECONDS", 0.05)
    assert answered(tmp_path, 40, lambda p: time.sleep(0.005) or f"a{p}") == [8, 16, 16]


def test_lost_task_finds_its_chunks(tmp_path):
    """Also those that another attempt cut elsewhere."""
    calls = []

    def dying(at):
        def scorer(payload):
            if len(calls) == at:
                raise RuntimeError
            calls.append(payload)
            return f"a{payload}"

        return scorer

    for at, most in ((10, 4), (13, 7), (None, 5)):
        try:
            answered(tmp_path, 20, dying(at), chunk=most, most=most)
        except RuntimeError:
            assert at is not None
    # 8 of the first 10 calls were kept, none of the next 3; then all others are asked.
    assert sorted(set(calls), key=int) == [str(k) for k in range(20)] and len(calls) == 25
