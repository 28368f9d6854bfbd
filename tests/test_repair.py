"""Orphan repair: dry and real, twice, with closings on both sides, chains, cycles and refusals."""

from tidemark.plans import repair

M = 60_000_000
EVENTS = "event_id string, home string, away string, start_us long, odds_id string, schedule_id string"
SNAPS = "event_id string, book string, market string, side string, captured_at long, price double, is_closing boolean"


def test_repair_moves_closes_and_deletes(spark):
    events = spark.createDataFrame(
        [("a", "H", "P", 0, "old", "824414"), ("b", "H", "P", M, "live", None), ("c", "H", "Q", 0, "lone", None), ("d1", "H", "R", 0, None, "1"), ("d2", "H", "R", 0, None, "2"), ("d", "H", "R", M, "twin", None), ("far", "H", "P", 6 * M, "later", None), ("e", "X", "Y", 0, "known", "3")], EVENTS)
    s = lambda e, side, at, closing=False: (e, "book", "moneyline", side, at, 1.9, closing)
    rows = [s("a", "home", 1), s("a", "home", 2, True), s("a", "away", 1), s("b", "home", 2), s("b", "home", 3, True), s("b", "away", 1, True), s("b", "away", 3), s("c", "home", 1, True), s("e", "home", 9, True), s("d", "home", 1)]
    snaps = spark.createDataFrame(rows, SNAPS)
    found = repair.orphans(events)
    assert {r.orphan_id: (r.state, r.event_id) for r in found.collect()} == {"b": ("repairable", "a"), "c": ("no_sibling", None), "d": ("ambiguous", None), "far": ("no_sibling", None)}
    left, kept, report = repair.repair(events, snaps, found)
    assert {tuple(r) for r in report.collect()} == {("b", "a", 1, 1, 2, 2)}
    want = {("a", "home", 1, False), ("a", "home", 2, True), ("a", "home", 3, False), ("a", "away", 1, True), ("a", "away", 3, False), ("c", "home", 1, True), ("e", "home", 9, True), ("d", "home", 1, False)}
    assert {(r.event_id, r.side, r.captured_at, r.is_closing) for r in kept.collect()} == want and kept.count() == len(want)
    assert {r.event_id: r.odds_id for r in left.collect()} == {"a": "live", "c": "lone", "d1": None, "d2": None, "d": "twin", "far": "later", "e": "known"}
    said = repair.summary(found, report, dry_run=True)
    assert (said["orphans_found"], said["repointable"], said["events_deleted"], said["demoted"], said["promoted"], said["duplicates"], said["repointed"]) == (4, 1, 1, 1, 1, 2, 2)
    assert said["skipped_no_sibling"] == ["c", "far"] and said["skipped_ambiguous"] == ["d"]
    again = repair.orphans(left)
    left2, kept2, report2 = repair.repair(left, kept, again)
    assert report2.count() == 0 and sorted(map(str, left2.collect())) == sorted(map(str, left.collect())) and sorted(map(str, kept2.collect())) == sorted(map(str, kept.collect()))
    # a pair that a person certified: the event keeps its own id
    by_hand = spark.createDataFrame([("c", "e", "lone")], "orphan_id string, event_id string, odds_id string")
    left3, kept3, _ = repair.repair(events, snaps, by_hand, hand_over=False)
    assert {r.event_id: r.odds_id for r in left3.collect()}["e"] == "known" and kept3.where("event_id = 'e' and captured_at = 1 and not is_closing").count() == 1


def test_two_orphans_of_one_event(spark):
    """The first orphan's closing stands where the event has none."""
    events = spark.createDataFrame([("a", "H", "P", 0, None, "1"), ("o1", "H", "P", M, "x", None), ("o2", "H", "P", 2 * M, "y", None)], EVENTS)
    snaps = spark.createDataFrame([("o1", "b", "m", "home", 1, 1.9, True), ("o2", "b", "m", "home", 2, 1.8, True), ("o2", "b", "m", "home", 1, 1.9, False)], SNAPS)
    left, kept, report = repair.repair(events, snaps, repair.orphans(events))
    assert sorted((r.event_id, r.captured_at, r.is_closing) for r in kept.collect()) == [("a", 1, True), ("a", 2, False)]
    assert [(r.event_id, r.odds_id) for r in left.collect()] == [("a", "y")]
    assert {r.orphan_id: (r.demoted, r.promoted, r.duplicates, r.repointed) for r in report.collect()} == {"o1": (0, 0, 0, 1), "o2": (1, 0, 1, 1)}
    empty = repair.repair(events.limit(0), snaps.limit(0), repair.orphans(events.limit(0)))
    assert [x.count() for x in empty] == [0, 0, 0]


def test_chains_end_and_cycles_are_refused(spark):
    chain = [(f"o{k}", f"o{k + 1}") for k in range(100)]
    pairs = chain + [("p", "q"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("into", "c1"), ("self", "self")]
    got = {r.orphan_id: (r.event_id, r.state) for r in repair.ends(spark.createDataFrame(pairs, "orphan_id string, event_id string")).collect()}
    assert all(got[f"o{k}"] == ("o100", "repairable") for k in range(100)) and got["p"] == ("q", "repairable")
    assert {got[k] for k in ("c1", "c2", "c3", "into", "self")} == {(None, "cycle")}
    only = {r.orphan_id: r.event_id for r in repair.ends(spark.createDataFrame(chain, "orphan_id string, event_id string")).collect()}
    assert set(only.values()) == {"o100"}
