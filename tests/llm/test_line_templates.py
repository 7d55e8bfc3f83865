import math
from collections import defaultdict
from itertools import combinations

import numpy as np

from basketlens.llm.line_templates import drop_recurring, templates
from helpers import documents, prose

#: Two documents make any line recur, two sequences any template.
TWO = {"min_docs": 2, "min_share": 0.0, "min_members": 2}


def brute_exact(rows):
    """Documents without their lines (five tokens or more) that, fields aside, occur in another document."""
    def key(line):
        return tuple("<*>" if any(c.isdigit() for c in x) else x for x in line.split())
    seen = defaultdict(set)
    for row in rows:
        for line in (row[1] or "").split("\n"):
            if len(key(line)) >= 5:
                seen[key(line)].add(row)
    out = []
    for doc_id, text in rows:
        kept = None if text is None else "\n".join(x for x in text.split("\n") if len(seen[key(x)]) < 2)
        n = 0 if text is None else len(text.split("\n"))
        out.append((doc_id, kept, n, sum(len(seen[key(x)]) > 1 for x in text.split("\n")) if text is not None else 0))
    return out


def letters(rng, n):
    return " ".join("".join(chr(97 + int(x)) for x in rng.integers(0, 26, 4)) for _ in range(n))


def test_exact_templates_same_as_brute_force(spark):
    rng = np.random.default_rng(6)
    shared = [f"Page {{}} of the manual {letters(rng, 4)}", letters(rng, 6), letters(rng, 4), "  spaced   out line of words "]
    rows = []
    for i in range(40):
        lines = [letters(rng, int(rng.integers(1, 30))) for _ in range(int(rng.integers(0, 6)))]
        lines[1:1] = [shared[k].format(i) for k in range(i % 5) if k < len(shared)] + ["", " "]
        rows.append((i, "\n".join(lines)))
    rows += [(40, None), (41, ""), (42, rows[1][1]), (43, rows[2][1]), (43, rows[2][1]), (None, "a null id with words " + shared[1]), (44, "\n\n"), (45, letters(rng, 30000)), (46, "once in a row\n" * 3)]
    got = drop_recurring(documents(spark, rows), **TWO).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_exact(rows)))
    assert drop_recurring(documents(spark, [])).count() == 0


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a line of five tokens"), (1, "a line of five tokens"), (2, "another line of five tokens here")]
    assert sorted(r.n_dropped for r in drop_recurring(documents(spark, rows), **TWO).collect()) == [0, 0, 0]


def test_fields_without_digits_are_generalised(spark):
    names = ["alice", "bob", "carol", "dave", "erin", "frank"]
    rows = [(i, f"user login event for {x} from the main office in town\nunique words {x} here") for i, x in enumerate(names)]
    rows += [(10, "user login event is something else entirely and not at all like"), (11, "user login event may well differ here since every word is another")]
    _, found = templates(documents(spark, rows))
    got = found.where("template is not null and recurs").collect()
    assert {" ".join(r.template) for r in got} == {"user login event for <*> from the main office in town"}
    dropped = {r.doc_id: r.n_dropped for r in drop_recurring(documents(spark, rows)).collect()}
    assert dropped == {**{i: 1 for i in range(6)}, 10: 0, 11: 0}


def test_several_templates_in_a_leaf(spark):
    words_a, words_b = "one two three red green blue black {} white", "one two three north south east west {} centre"
    rows = [(i, (words_a if i % 2 else words_b).format(chr(97 + i) * 3)) for i in range(10)]
    assert all(r.n_dropped == 1 for r in drop_recurring(documents(spark, rows)).collect())
    assert prose(np.random.default_rng(1), 3)


def masked(x, depth=3):
    """All templates of a token sequence: its count, leading tokens and what is left when two of eight segments (one token) go."""
    n = len(x)
    lead = min(depth, n - 4)
    m = n - lead
    cuts = [m * k // 8 for k in range(9)] if m >= 8 else list(range(m + 1))
    parts = [x[lead + p:lead + q] for p, q in zip(cuts, cuts[1:])]
    for gone in combinations(range(len(parts)), 2 if m >= 8 else 1):
        yield n, x[:lead], gone, tuple(p for k, p in enumerate(parts) if k not in gone)


def brute_templates(rows, min_docs=5, min_share=0.001, long_tokens=20, min_members=3, field=5):
    """Number of dropped lines of each row."""
    where, groups = defaultdict(set), defaultdict(set)
    for row in rows:
        for line in row[1].split("\n"):
            if line.split():
                where[tuple("<*>" if any(c.isdigit() for c in x) else x for x in line.split())].add(row)
    for x in where:
        for t in masked(x) if len(x) >= field else ():
            groups[t].add(x)

    def need(n):
        return 2 if n >= long_tokens else max(min_docs, math.ceil(min_share * len(rows) * 2.0 ** (1 - n)))

    recurs = {x for x in where if len(where[x]) >= need(len(x))}
    for t, members in groups.items():
        if len(members) >= min_members and len(set().union(*[where[x] for x in members])) >= need(t[0]):
            recurs |= members
    return sorted(sum(tuple("<*>" if any(c.isdigit() for c in x) else x for x in line.split()) in recurs for line in t.split("\n")) for _, t in rows)


def test_short_and_long_lines_same_as_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        lines = ["All rights reserved.", f"Posted by {letters(rng, 1)} in category music", letters(rng, 2), "Home"][: int(rng.integers(0, 5))]
        lines += [" ".join(["see the list"] + [str(x) for x in rng.choice(["red", "green", "blue"], int(rng.integers(1, 24)), p=[0.9, 0.05, 0.05])]) for _ in range(4)]
        rows.append((i, "\n".join(lines)))
    seen = set()
    for options in ({}, TWO, {"min_docs": 3, "min_share": 0.5, "min_members": 4}):
        got = sorted(r.n_dropped for r in drop_recurring(documents(spark, rows), min_tokens=1, **options).collect())
        assert got == brute_templates(rows, **options)
        seen.add(tuple(got))
    assert len(seen) == 3


def test_ordinary_prose_stays(spark):
    rows = [(1, "I like to eat apples"), (2, "I like to eat pears"), (3, "she went home after lunch today"), (4, "she went home before lunch today"), (5, "Yes"), (6, "Yes")]
    assert [r.text for r in drop_recurring(documents(spark, rows), min_tokens=1).orderBy("doc_id").collect()] == [t for _, t in rows]


def test_one_document_with_many_alike_lines_is_one(spark):
    rows = [(1, "\n".join(f"see also the entry on {x} in the index" for x in ["cats", "dogs", "birds", "fish", "mice", "owls"])), (2, "see also the entry on bees in the index")]
    assert [r.n_dropped for r in drop_recurring(documents(spark, rows)).collect()] == [0, 0]


def test_a_line_that_most_documents_hold_does_not_take_a_rare_neighbour(spark):
    rows = [(i, "all rights are reserved by the editors") for i in range(30)] + [(50, "all rights are reserved by the readers")]
    got = {r.doc_id: r.n_dropped for r in drop_recurring(documents(spark, rows)).collect()}
    assert got == {**{i: 1 for i in range(30)}, 50: 0}


def test_a_long_line_recurs_in_two_documents(spark):
    line = letters(np.random.default_rng(3), 20)
    rows = [(1, line + "\none line"), (2, "two lines\n" + line), (3, line[:-5])]
    assert {r.doc_id: r.text for r in drop_recurring(documents(spark, rows)).collect()} == {1: "one line", 2: "two lines", 3: line[:-5]}


def test_five_templates_in_a_leaf(spark):
    ends = [" ".join(letters(np.random.default_rng(k), 1) for _ in range(5)) for k in range(5)]
    rows = [(i, f"click here to {letters(np.random.default_rng(50 + i), 1)} {ends[i % 5]}") for i in range(10)]
    rows += [(20 + i, f"click here to {letters(np.random.default_rng(80 + i), 6)}") for i in range(4)]
    got = {r.doc_id: r.n_dropped for r in drop_recurring(documents(spark, rows), **TWO).collect()}
    assert got == {i: int(i < 10) for i, _ in rows}
