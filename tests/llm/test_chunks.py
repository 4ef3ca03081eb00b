"""Chunks of the compression bands."""

import random

import zstandard

from tidemark.llm import bands


def test_every_byte_is_in_a_chunk(docs):
    pick = random.Random(4)
    prose = " ".join("".join(pick.choice("etaoinshrdlu") for _ in range(pick.randint(2, 9))) for _ in range(4000))
    noise = "".join(chr(pick.randint(33, 126)) for _ in range(9000))
    cases = {1: prose[:8192] + noise[:4000], 2: prose[:8192] + "ab " * 1300, 3: prose[:12192], 4: prose[:8193], 5: prose[:16384] + noise[:3900], 6: prose[:20300]}
    got = {r.doc_id: r.quality for r in bands.judged(docs(*cases.items())).collect()}
    assert {i: q.n_chunks for i, q in got.items()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3, 6: 3}
    assert [i for i, q in sorted(got.items()) if q.n_low_chunks + q.n_high_chunks == 0] == [3, 4, 6]
    assert not got[1].kept and got[1].n_high_chunks == 1 and got[2].n_low_chunks == 1 and got[5].n_high_chunks == 1
    press = zstandard.ZstdCompressor(level=bands.LEVEL)
    low, high = bands.band(128)
    assert low <= len(press.compress(cases[4].encode()[-128:])) / 128 <= high
