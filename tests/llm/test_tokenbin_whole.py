from collections import Counter

import numpy as np

from weftgraph.llm import tokenbin


def test_compression_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(5)
    phrases = [rng.integers(3, 900, 40) for _ in range(60)]
    docs = [np.r_[np.concatenate([phrases[k] for k in rng.integers(0, 60, 30)]), 2].astype("<u4") for _ in range(40)]
    docs.append(np.r_[[9] * 200_000, 2].astype("<u4"))  # halved more than 12 times
    shard = tokenbin.Shard(tokenbin.pack(list(range(len(docs))), [d.tobytes() for d in docs], 1000))
    assert all(ids == d.tobytes() for (_, ids), d in zip(shard.all_documents(), docs))
    pairs = Counter()
    for a, b in zip(shard.first[:-1], shard.first[1:]):
        part = shard.symbols[a : b - 1].tolist()  # without the end id
        pairs.update(zip(part, part[1:]))
    assert max(pairs.values()) < tokenbin.LEAST_COUNT
    assert shard.first[-1] - shard.first[-2] < 20
