"""The substring removal's hashes: large buffers leave no tables behind."""

import numpy as np

from folioframe.llm import substring_dedup as S


def test_hashes_of_large_buffers_keep_no_tables():
    data = np.frombuffer(b"0123456789abcdef" * (3 * S.STRETCH // 16) + b"0123", np.uint8)
    prefix = S.prefix_hashes(np.r_[data, data])
    start = np.array([0, 5, len(data), len(data) + 5, 2 * S.STRETCH - 3])
    hashes = S.piece_hashes(prefix, start, 700)
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and hashes[0] != hashes[1]
    assert prefix[-1] == sum((int(b) + 1) * pow(S.BASE, i, 1 << 64) for i, b in enumerate(np.r_[data, data])) % (1 << 64)
    assert max(len(table) for table in S._powers.values()) == 2 * S.STRETCH
    assert len(S.power(S.BASE, 5 * S.STRETCH)) == 5 * S.STRETCH and len(S._powers[S.BASE]) == 2 * S.STRETCH
