"""A key's rows in many slots: few values of the state are touched, and one timer is set for each key and batch."""

import pandas as pd
from cairnkb.operators import usage
from cairnkb.streaming import limits


class Values(dict):
    calls = 0

    def keys(self):
        self.calls += 1
        return iter(list(super().keys()))

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]

    containsKey = dict.__contains__


class One:
    value = None
    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.timers, self.map = [], Values()

    def getMapState(self, *_):
        return self.map

    def getValueState(self, *_):
        return One()

    def registerTimer(self, at):
        self.timers.append(at)

    def listTimers(self):
        return iter(self.timers)


class Time:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_calls():
    hour, handle = limits.SLOT, Handle()
    start, step = usage.locker(2, 1000)
    machine = limits.InOrder(start, step, lambda state: None, "", ["user_id", "event_id", "at", "outcome", "failures"], hour)
    machine.init(handle)
    rows = [(1000 * hour * h + 5, h, h % 3 == 0) for h in range(400)]
    list(machine.handleInputRows((1,), iter([pd.DataFrame(rows[::-1], columns=["at", "event_id", "success"])]), Time(0)))
    assert len(handle.timers) == 1
    out = pd.concat(machine.handleExpiredTimer((1,), Time(390 * hour), Time(hour)))
    assert list(out["event_id"]) == list(range(390)) and handle.timers[-1] == 391 * hour and len(handle.timers) == 2
    rest = pd.concat(machine.handleExpiredTimer((1,), Time(900 * hour), Time(391 * hour)))
    assert list(rest["event_id"]) == list(range(390, 400)) and not handle.map and handle.map.calls < 20
