"""Approval of runs as a state machine over events: levels, roles and the path that a run has to take."""

from __future__ import annotations

#: Who may approve past all levels; the level that a run has when it is approved.
BYPASS, DONE = ("manager", "admin"), 4
#: (status, level, procurement, management) of a run that nobody has submitted.
START = ("draft", 0, False, False)
STATE = "status string, level int, procurement boolean, management boolean"
#: What `transition` puts out for each event.
OUT = "us long, event string, role string, status string, level int, accepted boolean"


def next_level(level: int, procurement: bool, management: bool) -> int:
    """The level after an approval at `level`: those that the run's path asks for, else done."""
    for to, asked in ((2, procurement), (3, management)):
        if to > level and asked:
            return to
    return DONE


def transition(state: tuple, event: tuple) -> tuple[tuple, list[tuple]]:
    """event: (us, event, role, procurement, management). What a status doesn't allow is refused and changes nothing.

    A submission (of a draft, or after a rejection or sending) sets the path. An approval takes a pending run on to its next level; managers and admins
    approve past all levels from the first one. An approved run may be approved again and stays as it is.
    """
    status, level, procurement, management = state
    us, kind, role, asks_procurement, asks_management = event
    accepted = True
    if kind == "submit" and status in ("draft", "rejected", "sent"):
        status, level, procurement, management = "pending", 1, bool(asks_procurement), bool(asks_management)
    elif kind == "approve" and status == "pending":
        level = DONE if level == 1 and role in BYPASS else next_level(level, procurement, management)
        status = "approved" if level == DONE else "pending"
    elif kind == "reject" and status == "pending":
        status = "rejected"
    elif kind == "send" and status == "approved":
        status = "sent"
    else:
        accepted = kind == "approve" and status == "approved"
    return (status, level, procurement, management), [(us, kind, role, status, level, accepted)]


def price_step(state: tuple, event: tuple) -> tuple[tuple, list[tuple]]:
    """event: (us, price) -> us, price, the price before, change in per cent."""
    (before,), (us, price) = state, event
    pct = 100 * (price - before) / before if before and price is not None else None
    return (price,), [(us, price, before, pct)]
