import time

from quern.llm import common


def test_idle_worker_forgets(monkeypatch):
    monkeypatch.setattr(common, "IDLE", 0.2)
    made = []
    make = lambda: made.append(1) or object()
    first = common.remembered("a", make)
    list(common.tidied(iter)([]))
    assert common.remembered("a", make) is first  # a task in time stops the clock
    time.sleep(0.5)
    assert common.remembered("a", make) is first and len(made) == 1
    list(common.tidied(iter)([]))
    time.sleep(0.5)
    assert common._held == (None, None)
    assert common.remembered("a", make) is not first and len(made) == 2


def test_one_operator_at_a_time():
    a = common.remembered("a", object)
    assert common.remembered("b", object) is not a and common._held[0] == "b"
