"""An executable model of version resolution, in plain Python, to hold the engine against."""

from collections import defaultdict

PUT, MERGE, CELL, COLUMN, FAMILY = 1, 2, 3, 4, 5


def standard(entries, snapshot=None, now=None, ttl=0, adds=False):
    """{(row, qualifier, ts): value} of a standard family; entries: row, qualifier, ts, seqno, op, kind, value."""
    seen = [e for e in entries if snapshot is None or e[3] <= snapshot]
    family, column, cells = defaultdict(lambda: -1), defaultdict(lambda: -1), set()
    for row, q, ts, _, _, kind, _ in seen:
        if kind == FAMILY:
            family[row] = max(family[row], ts)
        elif kind == COLUMN:
            column[row, q] = max(column[row, q], ts)
        elif kind == CELL:
            cells.add((row, q, ts))
    by = defaultdict(lambda: defaultdict(list))
    for row, q, ts, s, op, kind, v in seen:
        if kind not in (PUT, MERGE) or ts <= max(family[row], column[row, q]) or (row, q, ts) in cells or (ttl and now is not None and ts + ttl <= now):
            continue
        by[row, q][ts].append((s, op, kind, v))
    out = {}
    for (row, q), times in by.items():
        run, started = 0, None
        for ts in sorted(times, reverse=True):
            puts = [x for x in times[ts] if x[2] == PUT]
            base = max(puts) if puts else None
            newer = [x[3] for x in times[ts] if x[2] == MERGE and (base is None or x[:2] > base[:2])]
            if not adds:
                if base:
                    out[row, q, ts] = base[3]
                continue
            run += sum(newer)
            started = ts if started is None else started
            if base:
                out[row, q, started] = wrap(run + base[3])
                run, started = 0, None
        if adds and started is not None:
            out[row, q, started] = wrap(run)
    return out


def aggregate(entries, snapshot=None, fold=sum):
    seen = [e for e in entries if snapshot is None or e[3] <= snapshot]
    live = defaultdict(list)
    for row, q, ts, s, op, kind, v in seen:
        if kind not in (PUT, MERGE):
            continue
        hidden = any(
            d[3] > s and d[0] == row and ((d[5] == FAMILY and ts <= d[2]) or (d[1] == q and ((d[5] == COLUMN and ts <= d[2]) or (d[5] == CELL and ts == d[2]))))
            for d in seen
            if d[5] >= CELL
        )
        if not hidden:
            live[row, q, ts].append((s, op, kind, v))
    out = {}
    for key, own in live.items():
        puts = [x for x in own if x[2] == PUT]
        base = max(puts) if puts else None
        values = [x[3] for x in own if base is None or x[:2] >= base[:2]]
        out[key] = wrap(fold(values))
    return out


def wrap(n):
    return (n + 2**63) % 2**64 - 2**63
