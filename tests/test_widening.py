import itertools
import random

import pyarrow as pa
import pytest

from lamina.plans import widening as W
from lamina.plans.options import NumericMode, PayloadOptions, StringMode, TopLevelOptions, WideningOptions

PRAGMATIC = WideningOptions()
EXACT = WideningOptions(NumericMode.EXACT_SAFE)
TEXT = WideningOptions(strings=StringMode.PRIMITIVE_TO_STRING)
EXACT_TEXT = WideningOptions(NumericMode.EXACT_SAFE, StringMode.PRIMITIVE_TO_STRING)
i8, i16, i32, i64, u8, u16, u32, u64 = pa.int8(), pa.int16(), pa.int32(), pa.int64(), pa.uint8(), pa.uint16(), pa.uint32(), pa.uint64()
f32, f64, s, ls, b, null = pa.float32(), pa.float64(), pa.string(), pa.large_string(), pa.bool_(), pa.null()


@pytest.mark.parametrize("left,right,options,want", [
    (i8, i8, PRAGMATIC, i8), (f32, f32, EXACT, f32), (null, i32, PRAGMATIC, i32), (s, null, PRAGMATIC, s), (i8, i32, PRAGMATIC, i32), (u8, u32, PRAGMATIC, u32), (i8, u8, PRAGMATIC, i64), (i64, u32, PRAGMATIC, i64),
    (i64, u64, PRAGMATIC, f64), (i32, f32, PRAGMATIC, f64), (f32, f64, PRAGMATIC, f64), (i8, u8, EXACT, i16), (i32, u8, EXACT, i32), (i32, u32, EXACT, i64), (i64, u32, EXACT, i64), (u16, u64, EXACT, u64),
    (s, ls, PRAGMATIC, ls), (i32, s, TEXT, s), (ls, b, TEXT, ls), (b, i32, TEXT, s), (i32, f32, EXACT_TEXT, s), (pa.date32(), pa.date32(), PRAGMATIC, pa.date32()),
])
def test_scalar_joins(left, right, options, want):
    assert W.widen_type(left, right, options) == want
    assert W.widen_type(right, left, options) == want


@pytest.mark.parametrize("left,right,options", [
    (i32, f32, EXACT), (f32, f64, EXACT), (i64, u64, EXACT), (i32, s, PRAGMATIC), (b, i32, PRAGMATIC), (pa.date32(), i32, TEXT), (pa.struct([("x", i32)]), s, TEXT), (pa.list_(i32), pa.struct([("x", i32)]), TEXT),
    (pa.timestamp("us"), pa.timestamp("ms"), PRAGMATIC), (null, pa.date32(), PRAGMATIC),
])
def test_no_join(left, right, options):
    with pytest.raises(W.SchemaConflict):
        W.widen_type(left, right, options)


def test_structs_lists_nullability_and_order():
    left = pa.struct([pa.field("a", i32, False), pa.field("b", pa.list_(pa.field("item", i32, False)), False)])
    right = pa.struct([pa.field("c", s, False), pa.field("b", pa.large_list(pa.field("element", f64, True)), False), pa.field("A", i32, False)])
    got = W.widen_type(left, right)
    assert [f.name for f in got] == ["a", "b", "c", "A"]
    assert got.field("a").nullable and got.field("c").nullable and not got.field("b").nullable
    assert got.field("b").type == pa.large_list(pa.field("item", f64, True))


def test_conflicts_are_collected_with_paths():
    with pytest.raises(W.SchemaConflict) as e:
        W.merge_schemas(pa.schema([("a", s), ("b", i32)]), pa.schema([("a", pa.struct([("x", i32)])), ("b", pa.struct([("y", s)]))]))
    assert "2 conflict(s)" in str(e.value) and "field `a` " in str(e.value) and "field `b` " in str(e.value) and "Utf8" in str(e.value) and "Struct" in str(e.value)
    with pytest.raises(W.SchemaConflict, match="field `payload.x`"):
        W.merge_schemas(pa.schema([("payload", pa.struct([("x", i32)]))]), pa.schema([("payload", pa.struct([("x", pa.struct([("y", s)]))]))]))
    with pytest.raises(W.SchemaConflict, match="<root>"):
        W.widen_type(i32, s)
    with pytest.raises(W.SchemaConflict, match=r"field `l\[\]`"):
        W.merge_schemas(pa.schema([("l", pa.list_(i32))]), pa.schema([("l", pa.list_(s))]))


def test_metadata():
    one, other = pa.field("a", i32, True, {"k": "1"}), pa.field("a", i32, True, {"k": "2"})
    plain = pa.field("a", i64)
    assert W.merge_schemas(pa.schema([one]), pa.schema([plain])).field("a").metadata == {b"k": b"1"}
    assert W.merge_schemas(pa.schema([plain]), pa.schema([one])).field("a").metadata == {b"k": b"1"}
    with pytest.raises(W.SchemaConflict, match="metadata"):
        W.merge_schemas(pa.schema([one]), pa.schema([other]))
    assert W.merge_schemas(pa.schema([plain], {"x": "y"}), pa.schema([plain], {"x": "y"})).metadata is None


def test_top_level_contract():
    got = W.merge_top_level(pa.schema([pa.field("event_id", i32, False), ("score", i32), ("name", s)]), pa.schema([("score", f64), pa.field("event_id", i32, False), ("age", i32)]))
    assert got.names == ["event_id", "score", "name", "age"] and got.field("score").type == f64 and not got.field("event_id").nullable
    nested = pa.schema([("x", pa.struct([("a", i32)]))])
    assert W.merge_top_level(nested, nested) == nested
    with pytest.raises(W.SchemaConflict, match="field `x`"):
        W.merge_top_level(nested, pa.schema([("x", pa.struct([("a", i64)]))]))
    with pytest.raises(W.SchemaConflict, match="field `value`"):
        W.merge_top_level(pa.schema([("value", i32)]), pa.schema([("value", s)]))
    with pytest.raises(W.SchemaConflict):
        W.merge_top_level(pa.schema([("v", i32)]), pa.schema([("v", f32)]), TopLevelOptions(NumericMode.EXACT_SAFE))
    assert W.merge_top_level(pa.schema([("v", i32)]), pa.schema([("v", u8)]), TopLevelOptions(NumericMode.EXACT_SAFE)).field("v").type == i32


def test_payload_contract():
    p = pa.struct([("score", i32)])
    left = pa.schema([("id", i64), ("org", i64), ("payload", p)])
    assert W.merge_payload(left, pa.schema([("payload", pa.struct([("score", f64)])), ("org", i64), ("id", i64)])).names == ["id", "org", "payload"]
    for right, text in (
        (pa.schema([("id", i32), ("org", i64), ("payload", p)]), "field `id`"), (pa.schema([("id", i64), ("payload", p)]), "stable envelope column `org` is missing from right schema"),
        (pa.schema([("id", i64), ("org", i64), ("x", s), ("payload", p)]), "stable envelope column `x` is missing from left schema"), (pa.schema([("id", i64), ("org", i64)]), "missing required payload column"),
        (pa.schema([("id", i64), ("org", i64), ("payload", s)]), "must be Struct, found Utf8"),
    ):
        with pytest.raises(W.SchemaConflict, match=text):
            W.merge_payload(left, right)
    alone = pa.schema([("id", i64)])
    assert W.fold([alone], lambda a, b: W.merge_payload(a, b, PayloadOptions())) == alone  # a single input isn't checked


def test_mapping_and_fingerprint():
    a, c = pa.schema([("x", i32), ("y", s)]), pa.schema([("y", s), ("z", i32)])
    assert W.index_mapping(c, a) == [1, None]
    assert W.fingerprint(a) == W.fingerprint(pa.schema([("x", i32), ("y", s)])) != W.fingerprint(c)
    assert W.fingerprint(pa.schema([pa.field("x", i32, False)])) != W.fingerprint(pa.schema([("x", i32)])) != W.fingerprint(pa.schema([pa.field("x", i32, True, {"a": "b"})]))
    assert W.fingerprint(pa.schema([("x", pa.list_(i32))])) != W.fingerprint(pa.schema([("x", pa.large_list(i32))]))


def random_type(rnd, depth=2):
    kind = rnd.randrange(8 if depth else 6)
    if kind == 6:
        return pa.struct([pa.field(n, random_type(rnd, depth - 1), rnd.random() < 0.5) for n in rnd.sample("abcd", rnd.randint(1, 3))])
    if kind == 7:
        return pa.list_(random_type(rnd, depth - 1))
    return [i8, i64, u16, f32, f64, i32][kind]


def test_joins_are_idempotent_and_absorb_both_sides():
    rnd = random.Random(4)
    joined = 0
    for _ in range(400):
        a, c = (pa.schema([pa.field(n, random_type(rnd), rnd.random() < 0.5) for n in rnd.sample("abc", 2)]) for _ in range(2))
        try:
            m = W.merge_schemas(a, c)
        except W.SchemaConflict:
            continue
        joined += 1
        assert W.merge_schemas(m, m) == m and W.merge_schemas(m, a) == m and W.merge_schemas(m, c) == m
    assert joined > 50
    for x, y in itertools.product([i8, i16, i32, i64, u8, u16, u32, u64], repeat=2):
        exact = W.exact_integer(x, y)
        if exact is not None:
            assert exact.bit_width >= max(x.bit_width, y.bit_width)
