"""The streamed counters hold many (task, student) pairs per group of the stream."""

import pandas as pd

from inkgrade.streaming.uploads import AttemptCounter


class _Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row


class _Handle:
    def getValueState(self, name, schema):
        return _Value()


def _rows(*rows):
    frame = pd.DataFrame(rows, columns=["task_id", "student_id", "id", "at"])
    return frame.assign(bucket=1, mode="etalon", at=pd.to_datetime(frame["at"], unit="D"))


def test_one_group_counts_many_pairs():
    counter = AttemptCounter(2)
    counter.init(_Handle())
    for part in ([(1, 7, 1), (2, 9, 2)], [(3, 3, 5), (1, 2**60 + 1, 1)]):  # stored rows may come in parts
        counter.handleInitialState((1,), pd.DataFrame(part, columns=["task_id", "student_id", "prior"]).assign(bucket=1), None)

    def ask(*batches):
        out = pd.concat(list(counter.handleInputRows((1,), iter(batches), None)))
        assert len(out) == sum(map(len, batches))
        return {r.id: None if pd.isna(r.attempt_number) else r.attempt_number for r in out.itertuples()}

    got = ask(_rows((1, 7, "a", 9), (2, 9, "b", 1), (4, 4, "c", 5), (4, 4, "d", 6)), _rows((1, 7, "e", 8), (4, 4, "f", 5), (4, 4, "g", 1)))
    assert got == {"a": None, "e": 2, "b": None, "g": 1, "c": 2, "f": None, "d": None}
    # the next micro-batch goes on from the state
    assert ask(_rows((4, 5, "h", 1), (1, 2**60 + 1, "i", 1), (1, 2**60, "j", 1), (1, 7, "k", 0), (3, 3, "l", 0))) == {
        "h": 1, "i": 2, "j": 1, "k": None, "l": None}


def test_a_busy_pair_in_many_batches():
    counter = AttemptCounter(2)
    counter.init(_Handle())
    batches = [_rows(*[(1, 1, f"{i:03d}-{j}", 100 - i) for j in range(3)]) for i in range(50)]
    out = pd.concat(list(counter.handleInputRows((1,), iter(batches), None)))
    assert len(out) == 150 and out[out.status == "pending"].set_index("id").attempt_number.to_dict() == {"049-0": 1, "049-1": 2}
