import numpy as np
from hypothesis import given, settings, strategies as st
from pytest import MonkeyPatch

from criteria_engine.llm import line_dedup
from llm.llm_helpers import prose


def line(k):
    return prose(k, 6)


def lines(*ks):
    return "\n".join(line(k) for k in ks)


def aligned(a, b):
    """Lines of b on the patience alignment with a, told by recursion and whole tables."""
    i, out = 0, []
    while i < min(len(a), len(b)) and a[i] == b[i]:
        out.append((i, i))
        i += 1
    tail = 0
    while tail < min(len(a), len(b)) - i and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[i : len(a) - tail], b[i : len(b) - tail]
    once = [(x.index(v), k) for k, v in enumerate(y) if x.count(v) == 1 and y.count(v) == 1]
    if not x or not y:
        middle = []
    elif once:
        # longest ascending chain; `ends` says which chain the longest at each place comes from
        best = []
        for k, (p, _) in enumerate(once):
            before = [m for m in range(k) if once[m][0] < p]
            size = max((best[m][0] for m in before), default=0)
            # of equally long ones the chain whose last place in x is smallest
            last = min((m for m in before if best[m][0] == size), key=lambda m: once[m][0], default=None) if size else None
            best.append((size + 1, last))
        size = max(n for n, _ in best)
        k = min((k for k, (n, _) in enumerate(best) if n == size), key=lambda k: once[k][0])
        chain = []
        while k is not None:
            chain.append(once[k])
            k = best[k][1]
        middle, p, q = [], 0, 0
        for u, v in [*chain[::-1], (len(x), len(y))]:
            middle += [(p + m, q + n) for m, n in aligned(x[p:u], y[q:v])] + [(u, v)] * (u < len(x))
            p, q = u + 1, v + 1
    else:
        # lines that only one side has are left out first
        p, q = ([k for k, v in enumerate(side) if v in other] for side, other in ((x, y), (y, x)))
        middle = [(p[m], q[n]) for m, n in common([x[k] for k in p], [y[k] for k in q])]
    return out + [(i + m, i + n) for m, n in middle] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def common(x, y):
    """The longest common subsequence found from the ends on."""
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, u in enumerate(x):
        for j, v in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if u == v else max(table[i][j + 1], table[i + 1][j])
    i, j, out = len(x), len(y), []
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i][j - 1] == table[i][j]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def lost(a, b):
    """Places in b of aligned blocks of MIN_CHARS characters or more."""
    pairs, out, k = aligned(a, b), set(), 0
    while k < len(pairs):
        end = k + 1
        while end < len(pairs) and pairs[end] == (pairs[end - 1][0] + 1, pairs[end - 1][1] + 1):
            end += 1
        if sum(len(b[n]) for _, n in pairs[k:end]) >= line_dedup.MIN_CHARS:
            out |= {n for _, n in pairs[k:end]}
        k = end
    return out


def runs(own):
    """Runs of lines that reach MIN_CHARS and do not without their last line; a long line is one."""
    out = set()
    for i in range(len(own)):
        for j in range(i + 1, len(own) + 1):
            if sum(map(len, own[i:j])) >= line_dedup.MIN_CHARS:
                out.add(tuple(own[j - 1 : j] if len(own[j - 1]) >= line_dedup.MIN_CHARS else own[i:j]))
                break
    return out


def brute(rows):
    """Texts of all documents after line deduplication, from the definition."""
    docs = {i: [x.strip(" ") for x in t.split("\n")] for i, t in rows if i is not None and t}
    held = {i: {r for r in runs(own) if any(r)} for i, own in docs.items()}
    out = {}
    for i, own in docs.items():
        partners = {min(j for j in docs if r in held[j]) for r in held[i]} - {i}
        gone = set().union(*(lost(docs[j], own) for j in partners))
        out[i] = "\n".join(x for k, x in enumerate(dict(rows)[i].split("\n")) if k not in gone)
    return out


def cases():
    rows = [(1, lines(1, 2, 3, 4)), (2, lines(9, 2, 3, 8)), (3, lines(4, 7, 1)), (4, "short\n" + line(20)), (5, "short\n" + line(21))]
    rows += [(6, lines(1, 2, 3, 4)), (7, "  " + line(3) + " \n\n" + lines(30, 31)), (8, lines(30, 30, 31, 30)), (9, None), (10, "")]
    rows += [(11, "\n\n"), (None, lines(1, 2)), (12, lines(*range(40, 60))), (13, lines(*range(40, 50), 70, *range(50, 60)))]
    rows += [(100 + k, lines(80, 81, 200 + k)) for k in range(12)]
    return rows


def test_same_as_brute_force(documents):
    rows = cases()
    table = documents(*rows).withColumnRenamed("source", "n_lines").withColumnRenamed("lang", "text_hash").repartition(3)
    found = line_dedup.dedup_lines(table)
    assert found.columns == ["doc_id", "text", "text_hash", "n_chars", "n_lines", "n_removed"]
    kept = {(r.doc_id, r.text) for r in found.collect()}
    want = brute(rows)
    assert kept == {(i, want.get(i, t)) for i, t in rows}
    assert line_dedup.dedup_lines(documents((1, "x")).limit(0)).count() == 0


def test_frequent_lines_go_from_every_later_document(documents):
    """Two passages in 120 documents each, of which some hold both and a rarer line too."""
    rows = [(k, lines(1, 1000 + k)) for k in range(1, 121)] + [(k, lines(2, 1000 + k)) for k in range(201, 321)]
    rows += [(400 + k, lines(1, 1000 + k, 2, 2000 + k, 3000 + k // 2)) for k in range(20)]
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(*rows)).collect()}
    assert kept == brute(rows)
    assert not any(line(1) in t for i, t in kept.items() if i > 1) and not any(line(2) in t for i, t in kept.items() if i > 201)


@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14))
def test_every_common_block_has_a_common_passage(a, b):
    size, length = [0, 7, 12, 25], lambda xs: sum(size[x] for x in xs)
    keys = [set(line_dedup.passages(np.array(xs, np.int64) * 7919 - 5, np.array([size[x] for x in xs], np.int32)).tolist()) for xs in (a, b)]
    runs = [{tuple(xs[i:j]) for i in range(len(xs)) for j in range(i + 1, len(xs) + 1) if length(xs[i:j]) >= line_dedup.MIN_CHARS} for xs in (a, b)]
    assert bool(runs[0] & runs[1]) == bool(keys[0] & keys[1])


def test_blocks_of_short_lines_go(documents):
    verse = "one two three\n\nfour five\nsix seven"
    rows = [(1, lines(1) + "\n" + verse), (2, verse + "\n" + lines(2)), (3, "one two three\n" + lines(3)), (4, verse), (5, "six seven\n" + verse)]
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(*rows)).collect()}
    assert kept == {1: rows[0][1], 2: lines(2), 3: rows[2][1], 4: "", 5: "six seven"}


@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14), st.sampled_from([8, 1 << 25]))
def test_longest_common_subsequence(a, b, bits):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    with MonkeyPatch.context() as patch:
        patch.setattr(line_dedup, "TABLE_BITS", bits)
        found = line_dedup.longest_common(a, b)
    assert all(a[i] == b[j] for i, j in found) and len(found) == best[-1][-1]
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=20), st.lists(st.integers(0, 4), max_size=20), st.sampled_from([20, 7, 12]))
def test_blocks_do_not_depend_on_the_table(a, b, size):
    a, b = ([(x, size) for x in xs] for xs in (a, b))
    whole = line_dedup.common_blocks(a, b)
    assert sorted(whole) == sorted(lost([(x,) * n for x, n in a], [(x,) * n for x, n in b]))
    with MonkeyPatch.context() as patch:
        patch.setattr(line_dedup, "TABLE_BITS", 4)
        assert line_dedup.common_blocks(a, b) == whole


def test_blocks_in_other_orders(documents):
    """Of two blocks in the other order the aligned one goes, the other stays."""
    rows = [(1, lines(1, 2)), (2, lines(2, 1)), (3, lines(4, 5, 6, 7, 8, 9)), (4, lines(7, 8, 9, 4, 5, 6))]
    found = {r.doc_id: r for r in line_dedup.dedup_lines(documents(*rows)).collect()}
    assert {i: r.text for i, r in found.items()} == brute(rows)
    assert [found[i].n_removed for i in (1, 2, 3, 4)] == [0, 1, 0, 3]


def test_gaps_without_unique_lines_are_aligned():
    a, b = ([(x, 30) for x in xs] for xs in ([1, 5, 6, 2], [3, 5, 6, 7, 5, 6, 4]))
    assert line_dedup.common_blocks(a, b) == [4, 5]
    many = [(k % 7, 30) for k in range(6000)]
    assert len(line_dedup.patience([(98, 30), *many, (99, 30)], [(97, 30), *many, (96, 30)])) == 6000


def test_rows_of_one_id_keep_their_lines(documents):
    found = line_dedup.dedup_lines(documents((1, lines(1, 2)), (1, lines(1, 3)), (1, lines(1, 2)), (2, lines(3))))
    assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in found.collect()) == [(1, 2, 0)] * 3 + [(2, 1, 1)]


@given(st.lists(st.integers(0, 6), max_size=12), st.lists(st.integers(0, 6), max_size=12))
def test_patience_is_a_common_subsequence(a, b):
    a, b = [(x, 30) for x in a], [(x, 30) for x in b]
    found = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
    once = [x for x in a if a.count(x) == 1 and b.count(x) == 1]
    assert len(found) >= (1 if once else 0)
    if a == b:
        assert len(found) == len(a)
