"""Entity links against every pair in order, components against a union of sets, and the tracker's states by hand."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from planlark.operators import links as K
from planlark.operators import tracker as J

SCHEMA = "sid long, package long, answer long, at timestamp, place int, carrier long, folded boolean, page int, round int, record string, label string, words string, box struct<file:string,x0:double,y0:double,x1:double,y1:double>"


def made(seed, packages=12, answers=5, lines=6, words=4):
    """Random sightings with many chances to link and to conflict."""
    rng, rows, sid = random.Random(seed), [], 0
    for p in range(packages):
        for a in range(answers):
            first = None
            for place in range(rng.randint(1, lines)):
                sid += 1
                folded = first is not None and rng.random() < 0.2
                carrier = first if folded else sid
                first = first or sid
                maybe = lambda v, share=0.4: v if rng.random() < share else None  # noqa: B023, E731
                x, y, w = rng.randint(0, 12) * 15.0, rng.randint(0, 5) * 15.0, rng.choice((0.0, 30.0, 72.0, 73.0))
                box = maybe((rng.choice((None, "f", "g")), x, y, x + w, y + 5.0), 0.7)
                day = datetime(2024, 1, 1) + timedelta(days=rng.randint(0, 3))
                rows.append((sid, p, p * 100 + a, day, place, carrier, folded, maybe(rng.randint(1, 2), 0.8), maybe(rng.randint(1, 3), 0.9), maybe(f"r{rng.randint(1, 4)}", 0.2), maybe(f"l{rng.randint(1, 4)}", 0.2), rng.choice(["", None, *(f"w{k}" for k in range(words))]), box))
    day_of = {}
    return [(*r[:3], day_of.setdefault(r[2], r[3]), *r[4:]) for r in rows]


def brute(rows):
    """Every pair of a package's sightings in the order of links, sets held as lists."""
    keys = [f.split()[0] for f in SCHEMA.split(", ")]
    every = [dict(zip(keys, r, strict=True)) for r in rows]
    out = {}
    for p in {r["package"] for r in every}:
        mine = sorted((r for r in every if r["package"] == p), key=lambda r: (r["at"], r["answer"], r["place"]))
        for r in mine:
            r["round"] = r["round"] or 1
        sets = [{i} for i in range(len(mine))]
        of = lambda i: next(s for s in sets if i in s)  # noqa: B023, E731

        def join(i, j, mine=mine, sets=sets, of=of):
            a, b = of(i), of(j)
            if a is b:
                return True
            for x in a:
                for y in b:
                    if (mine[x]["answer"], mine[x]["round"]) == (mine[y]["answer"], mine[y]["round"]) and mine[x]["carrier"] != mine[y]["carrier"]:
                        return False
            sets.remove(b)
            a |= b
            return True

        order = list(dict.fromkeys(r["answer"] for r in mine))
        for answer in order:
            own = [i for i, r in enumerate(mine) if r["answer"] == answer]
            for i in own:
                for j in own:
                    if mine[i]["folded"] and not mine[j]["folded"] and mine[i]["carrier"] == mine[j]["carrier"]:
                        join(i, j)
            for w in dict.fromkeys(mine[i]["words"] for i in own if mine[i]["words"]):
                rounds = sorted({mine[i]["round"] for i in own if mine[i]["words"] == w})
                for one, two in zip(rounds, rounds[1:]):
                    lists = [sorted((i for i in own if mine[i]["words"] == w and mine[i]["round"] == r), key=lambda i: (mine[i]["page"] or 0, i)) for r in (one, two)]
                    for i, j in zip(*lists):
                        join(i, j)

        def strength(a, b):
            if a["record"] and a["record"] == b["record"]:
                return 0
            if a["label"] is not None and a["label"] == b["label"]:
                return 1
            if a["page"] is None or a["page"] != b["page"]:
                return None
            x, y = a["box"], b["box"]
            if x and y and all(abs(t[3] - t[1]) <= 72 and abs(t[4] - t[2]) <= 72 for t in (x, y)) and (x[0] is None or y[0] is None or x[0] == y[0]):
                dx, dy = max(0, max(x[1], y[1]) - min(x[3], y[3])), max(0, max(x[2], y[2]) - min(x[4], y[4]))
                if (dx * dx + dy * dy) ** 0.5 <= 18:
                    return 2
            return 3 if a["words"] and a["words"] == b["words"] else None

        for k, answer in enumerate(order):
            links = []
            for i, a in enumerate(mine):
                for j, b in enumerate(mine):
                    if a["answer"] == answer and b["answer"] in order[:k] and (s := strength(a, b)) is not None:
                        links.append((s, i, order.index(b["answer"]), j))
            linked = set()
            for _, i, old, j in sorted(links):
                if (i, old) not in linked and join(i, j):
                    linked.add((i, old))
        for s in sets:
            for i in s:
                out[mine[i]["sid"]] = mine[min(s)]["sid"]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_every_pair_in_order(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"component": F.lit("x"), "item": F.lit(0)})
    got = {r.sid: r.item for r in K.entity_links(df.repartition(3)).collect()}
    assert got == brute(rows)


def test_links_inside_one_crowded_page(spark):
    """All of one package, page and words: nothing is told apart but by the rule of one finding a round."""
    rows = made(3, packages=1, answers=12, lines=12, words=1)
    got = {r.sid: r.item for r in K.entity_links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_no_sightings(spark):
    assert K.entity_links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(-7, -3), (50, 50)] + [(rng.randint(1000, 1080), rng.randint(1000, 1080)) for _ in range(50)]
    low = {n: n for ab in links for n in ab}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= (low[a], low[b]) != (m, m)
            low[a] = low[b] = m
    got = {r.node: r.component for r in K.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    alone = {n for n in low if all(a == b for a, b in links if n in (a, b))}
    assert got == {n: c for n, c in low.items() if n not in alone}


def day(n):
    return datetime(2024, 1, 1) + timedelta(days=n)


def test_states_by_hand(spark):
    schema = "sid long, item long, package long, answer long, at timestamp, place int, folded boolean, page int, stated_round int, status string, compared boolean, told string, decision string, decided_at timestamp, decided_by string"
    sight = lambda sid, item, answer, r, status, **more: (sid, item, 1, answer, day(answer), sid, more.get("folded", False), 1, r, status, more.get("compared", True), more.get("told"), more.get("decision"), more.get("decided"), more.get("by"))
    rows = [
        sight(1, 1, 1, 1, "different"), sight(2, 1, 2, 2, "same"),  # fixed in round 2
        sight(3, 3, 1, 1, "different"), sight(4, 3, 2, 2, "same", compared=False),  # the second says nothing: still open
        sight(5, 5, 1, 1, "different"), sight(6, 5, 2, 1, "same"),  # right later, in the same round
        sight(7, 7, 1, 1, "different"), sight(8, 7, 2, 2, "different"),  # wrong twice
        sight(9, 9, 1, 1, "check", told="now_right"),  # fixed in the round after
        sight(10, 10, 1, 1, "different", decision="agreed", decided=day(5), by="a"), sight(11, 10, 2, 2, "different", decision="not_a_problem", decided=day(6), by="b"),
        sight(12, 12, 1, 1, "different", decision="not_a_problem", decided=day(6), by="a"), sight(13, 12, 2, 2, "different", decision="agreed", decided=day(9), by="b"),
        sight(14, 14, 2, 2, "check", told="still_not_compared"),  # new
        sight(15, 15, 1, 1, "same"),  # right everywhere: no item
        sight(16, 16, 1, 1, "check"), sight(17, 16, 2, 1, "different"), sight(18, 16, 2, 1, "check", folded=True),  # the newest check's own finding
    ]
    s = K.filled_rounds(spark.createDataFrame(rows, schema))
    judged = J.items(s)
    got = {r["item"]: (r.state, r.open_kind, r.fixed_round, r.tags) for r in judged.collect()}
    assert got == {
        1: ("fixed", None, 2, ""),
        3: ("open", "wrong", None, ""),
        5: ("right_later", None, None, ""),
        7: ("open", "wrong", None, "Previous comment not addressed"),
        9: ("fixed", None, 2, ""),
        10: ("not_a_problem", None, None, ""),
        12: ("open", "wrong", None, "Previous comment not addressed"),
        14: ("open", "decision", None, "New, Still not compared"),
        16: ("open", "wrong", None, ""),
    }
    counts = {r["round"]: (r["items"], r.open, r.wrong, r.decision, r.fixed) for r in J.round_counts(s, judged).collect()}
    assert counts == {1: (8, 6, 5, 1, 0), 2: (5, 3, 2, 1, 2)}


def test_rounds_are_filled_from_the_page(spark):
    rows = [(1, 1, 5, 2), (2, 1, 5, 2), (3, 1, 5, 1), (4, 1, 5, None), (5, 1, 6, None), (6, 1, None, None), (7, 1, 7, 3), (8, 1, 7, 1), (9, 1, 7, None), (10, 2, 5, None), (11, 2, 5, -4)]
    got = {r.sid: r["round"] for r in K.filled_rounds(spark.createDataFrame(rows, "sid long, package long, page int, stated_round int")).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 2, 5: 1, 6: 1, 7: 3, 8: 1, 9: 1, 10: 1, 11: 1}
