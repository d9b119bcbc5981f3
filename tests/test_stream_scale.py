"""Corrections of many ids."""

import pandas as pd

from carelake.streaming import correction_stream as S


class Held:
    """State of a group, as the engine hands it to the function."""

    def __init__(self):
        self.value, self.timer, self.now, self.hasTimedOut = None, None, 0, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, t):  # noqa: N802 - the engine's name
        assert t > self.now
        self.timer = t

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.now


def _rows(rows):
    given = pd.DataFrame(rows, columns=["feedback_id", "at", "pending", "correct_risk"])
    return given.astype({"at": "datetime64[ms]"})


def test_one_call_serves_many_ids_and_each_has_its_own_timer():
    run, state = S._resolve(1000), Held()
    first = _rows([(1, 100, True, None), (2, 300, True, None), (2, 400, False, "High"), (3, 500, False, "Low"), (2, 400, False, "Low"), (4, 5000, True, None)])
    out = pd.concat(run((0,), iter([first]), state))
    assert out.values.tolist() == [[2, 0, "corrected"]] and state.timer == 1100  # the greatest text of one time counts
    state.now = 1200  # id 1 is over though other ids of the group bring rows
    out = pd.concat(run((0,), iter([_rows([(3, 900, True, None), (2, 300, True, None)])]), state))
    found = {r[0]: r[1:] for r in out.values.tolist()}
    assert found[3] == [0, "corrected"] and found[1][1] == "expired" and pd.isna(found[1][0]) and len(found) == 2
    state.now, state.hasTimedOut = 9000, True
    out = pd.concat(run((0,), iter([]), state))
    assert out["feedback_id"].tolist() == [4] and out["status"].tolist() == ["expired"] and not state.exists
