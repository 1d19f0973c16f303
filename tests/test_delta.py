"""Block deltas: rolling sums, matching against a plain scan, byte-exact rebuilding, boundary tables."""

import random

import pytest

from driftwright.operators import delta as D
from driftwright.operators.links import matching


def plain(old, new_size, sig, block, strong):
    by = {}
    for k, w, s, n in reversed(sig):
        if n == block:
            by.setdefault(w, []).append((k, s))
    found, p = {}, 0
    while p + block <= len(old):
        window = old[p : p + block]
        hit = next((k for k, s in by.get(D.weak_of(window), []) if k not in found and s == strong(window)), None)
        if hit is None:
            p += 1
        else:
            found[hit] = p
            p += block
    return found


@pytest.mark.parametrize("seed", range(30))
def test_match_equals_plain_scan_and_rebuilds(seed):
    r = random.Random(seed)
    block = r.choice([4, 8, 16])
    old = bytes(r.choices(b"abc", k=r.randrange(0, 300)))
    parts = [old[a : a + r.randrange(1, 60)] for a in r.choices(range(max(1, len(old))), k=4)] + [bytes(r.choices(b"xyz", k=9))]
    r.shuffle(parts)
    new = b"".join(parts)
    sig = D.signature(new, block)
    found, _ = D.match(old, len(new), sig, block)
    assert found == plain(old, len(new), sig, block, D.canonical_hash)
    ops = D.plan_ops(found, len(new), block)
    assert D.rebuild(old, lambda a, n: new[a : a + n], ops) == new


def test_rolling_equals_direct():
    data = random.Random(1).randbytes(5000)
    assert D.rolling_weak(data, 700).tolist() == [D.weak_of(data[i : i + 700]) for i in range(4301)]


@pytest.mark.parametrize(("size", "block"), [(1 << 20, 2048), (16 << 20, 4096), (128 << 20, 12288), (1 << 30, 32768), (1 << 40, 131072)])
def test_block_sizes(size, block):
    assert D.choose_block_size(size) == block


def test_hash_layouts():
    assert D.canonical_hash(b"hello").hex() == "b5e9c1ad071b3e7fc779cfaa5e523818"
    assert D.raw_hash(b"hello").hex() == "1838525eaacf79c77f3e1b07adc1e9b5"


def test_early_stop_gives_an_empty_plan():
    old, new = random.Random(2).randbytes(1 << 20), random.Random(3).randbytes(1 << 20)
    found, stats = D.match(old, len(new), D.signature(new, 2048), 2048, prefix=8192)
    assert not found and stats["stopped"] and stats["scanned"] == 8192


def test_matching_augments():
    assert len(matching([(1, "a"), (1, "b"), (2, "a")])) == 2
