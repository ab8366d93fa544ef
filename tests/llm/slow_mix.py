"""A plain version of the mixing operator: loops over dictionaries."""

import re
import struct

import xxhash


def place(row):
    text = row["text"] or ""
    tokens = len(re.findall(r"[^\x20\x09-\x0D]+", text)) if text.strip(" ") else 0
    marks = len(re.findall(r"[|#*$%&]", text))
    topic = "marked" if marks * 5 > tokens else "note" if tokens < 100 else "long" if tokens >= 1000 else "prose"
    return (row["source"] or "(none)", row["lang"] or "(none)", topic), tokens


def draw(doc_id):
    seed = xxhash.xxh64(struct.pack("<q", doc_id), seed=42).intdigest() if doc_id is not None else 42
    return (xxhash.xxh64(b"mix", seed=seed).intdigest() >> 11) / (1 << 53)


def chances(rows, power=0.5, share=0.5):
    """The probability of each cell."""
    cells = {}
    for row in rows:
        cell, n = place(row)
        cells[cell] = cells.get(cell, 0) + n
    total = sum(cells.values())
    if not total:
        return dict.fromkeys(cells, 0.0)
    goals = []
    for axis in range(3):
        held = {}
        for cell, n in cells.items():
            held[cell[axis]] = held.get(cell[axis], 0) + n
        raised = {k: v**power if v else 0.0 for k, v in held.items()}
        goals.append({k: v / sum(raised.values()) for k, v in raised.items()})
    weight = {c: n / total for c, n in cells.items()}
    for _ in range(60):
        for axis in range(3):
            held = {}
            for c, w in weight.items():
                held[c[axis]] = held.get(c[axis], 0) + w
            weight = {c: w * goals[axis][c[axis]] / held[c[axis]] if held[c[axis]] else 0.0 for c, w in weight.items()}
    chance, open_, left = dict.fromkeys(cells, 0.0), {c for c in cells if cells[c] and weight[c]}, share * total
    while open_:
        scale = left / sum(weight[c] for c in open_)
        full = {c for c in open_ if weight[c] * scale >= cells[c]}
        for c in full or open_:
            chance[c] = 1.0 if full else weight[c] * scale / cells[c]
        if not full:
            break
        left, open_ = left - sum(cells[c] for c in full), open_ - full
    return chance


def sample(rows):
    chance = chances(rows)
    return [r for r in rows if draw(r["doc_id"]) < chance[place(r)[0]]]
