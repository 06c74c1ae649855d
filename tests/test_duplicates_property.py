"""Property: the duplicate operators equal a brute-force first-seen scan."""

from hypothesis import given, settings, strategies as st

from keyedit.operators import checks as ck


def brute(rows):
    """The reference's loop: walk rows in sheet order, pair each repeat with its first row."""
    first, pairs, order = {}, [], []
    for row_num, key in sorted(rows):
        if key is None:
            continue
        if key in first:
            pairs.append((key, first[key], row_num))
            if key not in order:
                order.append(key)
        else:
            first[key] = row_num
    return pairs, order


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 8)), min_size=1, max_size=150), st.booleans())
def test_duplicates_match_brute_force(spark, keys, salted):
    rows = [(i * 3 + 2, k) for i, k in enumerate(keys)]          # unique sheet rows, shuffled order below
    rows = rows[::2] + rows[1::2]
    df = spark.createDataFrame(rows, "row_num long, key_value long")
    if salted:
        spark.conf.set("keyedit.broadcast.maxRows", "0")
        spark.conf.set("keyedit.skew.hotRows", "5")
    try:
        pairs = sorted(tuple(r) for r in ck.duplicate_pairs(df).collect())
        order = [r["key_value"] for r in ck.duplicate_keys_ordered(df).collect()]
        lists = {}
        for r in ck.duplicate_key_rows(df, rows_per_chunk=50).orderBy("key_value", "chunk").collect():
            lists.setdefault(r["key_value"], []).append(r["rows"])
    finally:
        spark.conf.unset("keyedit.broadcast.maxRows")
        spark.conf.unset("keyedit.skew.hotRows")
    want_pairs, want_order = brute(rows)
    assert pairs == sorted(want_pairs)
    assert order == want_order
    for key, chunks in lists.items():
        want = sorted(r for r, k in rows if k == key)
        assert ", ".join(chunks) == ", ".join(map(str, want))
    assert set(lists) == set(want_order)
