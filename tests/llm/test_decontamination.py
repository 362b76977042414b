from hypothesis import given, settings, strategies as st

from criteria_engine.llm import decontaminate as dec
from llm.llm_helpers import prose


def distance(item, text):
    """Smallest edit distance of the item to a passage, and the first end of such a one."""
    row = list(range(len(item) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(text):
        new = [0]
        for i, p in enumerate(item):
            new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (p != c)))
        row = new
        best = min(best, (row[-1], j + 1))
    return best


@settings(deadline=None)
@given(st.text("ab ", min_size=1, max_size=70), st.text("ab ", max_size=90))
def test_myers(item, text):
    assert dec.myers(item, text) == distance(item, text)


@settings(deadline=None, max_examples=60)
@given(st.text("abc", min_size=20, max_size=60), st.lists(st.tuples(st.integers(0, 60), st.sampled_from(["", "x", "ab"])), max_size=4))
def test_finds_all_within_the_budget(item, edits):
    copy = item
    for at, new in edits:
        copy = copy[:at] + new + copy[at + 1 :]
    text = f"qqqq {copy} qq {copy[::-1]} q"
    best, _ = distance(item, text)
    found = dec.Items([(1, item)], 0.1).matches(text)
    if best <= dec.budget(len(item), 0.1):
        assert [m[1] for m in found] == [best]
        start, end = found[0][2:]
        assert distance(item, text[start:end])[0] == best
    else:
        assert not found


def test_documents(spark, documents, monkeypatch):
    item, other = prose(1, 30), prose(2, 25)
    near = item.replace(item.split()[3], "zz", 1)
    rows = [
        (1, f"{prose(3, 20)} {item} {prose(4, 9)}"), (2, f"{prose(5, 20)}. {item.upper()}!"), (3, f"{near} {other}"),
        (4, prose(6, 400)), (5, None), (6, ""), (None, item), (7, prose(7, 20000) + " " + item), (1, other), (1, other),
        (8, item.replace("a", "z").replace("b", "y").replace("c", "x")),
    ]
    bench = spark.createDataFrame(
        [(10, item), (11, other), (12, None), (13, ""), (14, "?!"), (None, other), (10, "unlike " * 9), (10, item), (10, item[:40])], "item_id long, text string"
    )
    wanted = sorted(
        [(1, 10, 0), (1, 11, 0), (1, 11, 0), (1, None, 0), (1, None, 0), (2, 10, 0), (3, 11, 0), (3, None, 0), (7, 10, 0), (None, 10, 0)]
        + [(3, 10, distance(item, near)[0])],
        key=str,
    )
    for chars in (10**6, 300):  # one pass, several passes
        monkeypatch.setattr(dec, "BLOCK_CHARS", chars)
        found = dec.contaminated(documents(*rows).withColumnRenamed("lang", "item_id"), bench)
        assert sorted(((r.doc_id, r.item_id, r.distance) for r in found.collect()), key=str) == wanted
    assert dec.contaminated(documents((1, "x")).limit(0), bench).count() == 0
    assert dec.contaminated(documents(*rows), bench.limit(0)).count() == 0
    kept = dec.find_items(documents(*rows), bench).where("size(matches) = 0")
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 8]
