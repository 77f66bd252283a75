"""The greedy cut of push chunks against a plain loop over the entries."""

import random

import pyarrow as pa

from logsift.sinks.lines import _greedy_cut


def plain(rows, most, limit):
    out, stream = [], None
    for key, minute, size in rows:
        if (key, minute) != stream:
            stream, chunk, n, total = (key, minute), 0, 0, 0
        elif n >= most or total >= limit:
            chunk, n, total = chunk + 1, 0, 0
        n, total = n + 1, total + (size or 0)
        out.append(chunk)
    return out


def test_cut_is_the_plain_one_over_any_batches():
    r = random.Random(1)
    names = ["stream_key", "minute", "entry_bytes"]
    for _ in range(300):
        rows = sorted(((r.choice("ab"), r.choice([0, 1]), r.choice([None, 0, 1, 5, 50, 200])) for _ in range(r.randint(0, 60))), key=lambda x: x[:2])
        rows += [(None, None, 7)] * r.randint(0, 4)
        most, limit = r.choice([(1, 100), (3, 60), (5, 1), (1000, 120), (4, 10**9)])
        batches, at = [], 0
        while at < len(rows):
            part = rows[at:at + r.randint(1, 20)]
            at += len(part)
            cols = [pa.array([x[0] for x in part], pa.string()), *[pa.array([x[i] for x in part], pa.int64()) for i in (1, 2)]]
            batches.append(pa.RecordBatch.from_arrays(cols, names))
        got = [c for b in _greedy_cut(most, limit)(iter(batches)) for c in b["chunk"].to_pylist()]
        assert got == plain(rows, most, limit)
