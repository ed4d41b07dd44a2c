"""Names, defaults and clashes of the feature registry."""

import pytest

from tickloom.operators.registry import Registry, standard


def test_settings():
    registry = standard()
    assert [t.name for t in registry.tunables()][:3] == ["ict__lookback", "ict__level_max_age", "scalp__roc_fast"]
    own = registry.settings({"scalp__roc_fast": 3.7, "roc_slow": 1, "other__roc_slow": 2})
    assert own["scalp"] == {"roc_fast": 3, "roc_slow": 20, "mean_rev_period": 30, "atr_period": 14}
    assert own["tick"] == {"spread_avg_period": 30}


def test_names_are_unique():
    one = standard().sets[0]
    with pytest.raises(ValueError):
        Registry([one, one])
