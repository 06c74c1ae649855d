"""Property: outcomes and the new target equal a plain-Python model of the rules."""

from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

from hypothesis import given, settings, strategies as st

from keyedit.operators import apply as ap
from keyedit.operators.staging import bind_changeset, coerce_changes, stage_as_text

SPELL = st.sampled_from(["{}", "00{}", " {} ", "{}.0", "{}e0", "x{}"])
QTY = st.sampled_from(["5", "2.5", "-1.5", "abc", "", None, "1e1", " 7 "])
NAME = st.sampled_from(["a", "", None, "zz"])


def _dec(text):
    try:
        return Decimal(text.strip())
    except (InvalidOperation, AttributeError):
        return None


def _order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def model(target, changes):
    keys_in_target = {}
    for k, _, _ in target:
        keys_in_target[k] = keys_in_target.get(k, 0) + 1
    outcomes, updates = {}, {}
    for row_num, key_text, qty_text, name_text in changes:
        d = _dec(key_text)
        key = int(d) if d is not None and d == d.to_integral_value() else None
        qty_text = qty_text if qty_text != "" else None
        name = name_text if name_text != "" else None
        q = _dec(qty_text) if qty_text is not None else None
        qty = int(q.quantize(Decimal(1), rounding=ROUND_HALF_UP)) if q is not None else None
        if key is None or key not in keys_in_target:
            outcomes[row_num] = "missing_key"
        elif qty_text is not None and qty is None:
            outcomes[row_num] = "type_mismatch"
        elif qty is None:
            outcomes[row_num] = "null_not_allowed"
        else:
            outcomes[row_num] = "applied"
            updates[key] = (qty, name)
    new = _order((k, *updates[k]) if k in updates else (k, q, n) for k, q, n in target)
    return outcomes, new


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9), NAME), min_size=1, max_size=20),
       st.lists(st.tuples(SPELL, QTY, NAME), min_size=1, max_size=8, unique_by=lambda t: t[0]),
       st.lists(st.integers(0, 9), min_size=8, max_size=8, unique=True))
def test_outcomes_and_target_match_the_model(spark, target, change_specs, keys):
    changes = [(i + 2, spell.format(keys[i]), qty, name) for i, (spell, qty, name) in enumerate(change_specs)]
    t = spark.createDataFrame(target, "ID long, qty int, name string")
    raw = spark.createDataFrame(changes, "row_num long, k string, q string, n string")
    bound = bind_changeset(raw, ["qty", "name"])
    co = coerce_changes(stage_as_text(bound, ["qty", "name"]), t.schema, "ID", ["qty", "name"], frozenset({"QTY"}))
    got_oc = {r["row_num"]: r["status"] for r in ap.row_outcomes(co, t, "ID").collect()}
    got_new = _order(tuple(r) for r in ap.apply_updates(t, co, "ID", ["qty", "name"]).collect())
    want_oc, want_new = model(target, changes)
    assert got_oc == want_oc
    assert got_new == want_new
