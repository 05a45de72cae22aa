"""Column names of the standard event log and the pairing of a user's columns with them."""

from __future__ import annotations

from dataclasses import dataclass

# Standard column names.
TRACE = "trace"
ACTIVITY = "activity"
START = "timestamp"  # epoch milliseconds
COMPLETE = "timestampf"  # epoch milliseconds
SEQ = "event_seq"  # breaks ties between events of a case with the same start
POS = "pos"  # 1-based place of an event in its case
PART = "case_part"  # slice number of an event of a very large case, null elsewhere
SEGMENT = "segment"  # which run of `SEGMENT_EVENTS` positions a row of arrays covers

EMPTY = "-"  # fixed value: stands for an empty cell

# Names of the synthetic first and last activity, and how long they last.
START_TASK = "_START_"
END_TASK = "_END_"
DUMMY_MS = 1000

#: Order of the events of a case; logs without a sequence number have the same one everywhere.
ORDER = (START, SEQ, COMPLETE, ACTIVITY)
SEGMENT_EVENTS = 100_000


@dataclass(frozen=True)
class LogSpec:
    """Which user columns play the four roles, and how their times are written."""

    trace: str
    activity: str
    start: str
    complete: str
    pattern: str = "yyyy/MM/dd HH:mm:ss"
    sequence: str | None = None

    @property
    def instant(self) -> bool:
        """One column serves as start and complete, so starts have to be made up."""
        return self.start == self.complete

    def roles(self) -> dict[str, str]:
        """User column -> standard column."""
        return {self.complete: COMPLETE, self.start: START, self.activity: ACTIVITY, self.trace: TRACE}
