"""A series of bars gives the same events whether its state is carried over batches or not."""

import random

from tickloom.streaming.detectors import Series

RULES = (2, 14, 1.5, 2.0)


def bars(n):
    draw, price = random.Random(5), 100.0
    for at in range(n):
        opened, price = price, price + draw.gauss(0, 1) * draw.choice((1, 1, 4))
        yield at, opened, max(opened, price) + draw.random(), min(opened, price) - draw.random(), price


def test_state_carries_over():
    whole, parts, state = Series(None, *RULES), [], None
    want = [e for bar in bars(400) for e in whole.add(*bar)]
    for bar in bars(400):
        series = Series(state, *RULES)
        parts += series.add(*bar)
        state = series.state()
    assert parts == want
    assert {e[0] for e in want} == {"swing", "break", "gap", "displacement", "block"}


def test_state_is_bounded():
    series = Series(None, *RULES)
    for bar in bars(400):
        series.add(*bar)
    assert len(series.state()[0]) == 14
