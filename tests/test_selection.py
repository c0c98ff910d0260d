import pytest

from tidelane.operators.selection import cache_is_enough, ladder, resolve
from tidelane.sources.paged import Bucket


def test_resolve_keeps_registry_order():
    assert resolve(["volume_ratio", "return_1h"]) == ["return_1h", "volume_ratio"]
    assert resolve("none") == [] and set(resolve("sentiment")) < set(resolve("all"))
    with pytest.raises(ValueError):
        resolve("nonsense")


def test_ladder_sorts_and_refuses_equal_durations():
    assert [h.label for h in ladder(["30d", "24h", "1w"])] == ["24h", "1w", "30d"]
    with pytest.raises(ValueError):
        ladder(["24h", "1d"])
    with pytest.raises(ValueError):
        ladder(["0h"])


def test_cache_is_reused_and_not_refetched_in_vain():
    assert cache_is_enough((0, 10), None, (2, 9)) == (True, False)
    assert cache_is_enough((3, 10), (0, 10), (0, 10)) == (False, False)
    assert cache_is_enough((3, 10), None, (0, 10)) == (False, True)
    assert cache_is_enough(None, None, (0, 1)) == (False, True)


def test_bucket_waits_when_empty():
    now = [0.0]
    b = Bucket(rate=2, size=2, clock=lambda: now[0])
    assert [b.take(), b.take(), b.take()] == [0, 0, 0.5]
    now[0] = 10
    assert b.take(2) == 0
