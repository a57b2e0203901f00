"""The token coder's tables are narrow where a block's counts allow it, and of the same content where they don't."""

import numpy as np

from trackweave.llm.token_store import _Mixer


def test_narrow_tables():
    rng = np.random.default_rng(5)
    narrow, wide = _Mixer(64, 500, 1 << 20), _Mixer(64, 500, 1 << 40)
    seen = rng.integers(0, 96, 900), rng.integers(0, narrow.after.size, 5000)
    for mixer in (narrow, wide):
        mixer.kept.append(seen)
        mixer.rebuild()
    assert narrow.sums.dtype == np.int32 and wide.sums.dtype == np.int64 and (narrow.sums == wide.sums).all()
    after = rng.integers(0, narrow.contexts, 2000)
    value = (rng.random(2000) * narrow.total[after]).astype(np.uint64)
    value[:100], value[100:200] = 0, narrow.total[after[100:200]] - np.uint64(1)
    want = [a * 501 + int(np.searchsorted(wide.sums[a].astype(np.int64) - int(wide.base[a]), int(v), side="right")) - 1 for a, v in zip(after.tolist(), value.tolist())]
    assert narrow.find(after, value).tolist() == wide.find(after, value).tolist() == want
