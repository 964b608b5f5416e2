import random

import pytest

from relgrid.domain import Object, Subject, Tuple, ident, name, tenant
from relgrid.engine import Token
from relgrid.errors import ConsistencyError, DomainError
from relgrid.functions import columns as fn


@pytest.mark.parametrize("text", ["doc:readme#viewer@user:alice", "doc:a.b|c#v@group:eng#member", "folder:A#owner@user:bob"])
def test_tuple_text_round_trip(text):
    assert str(Tuple.parse(text)) == text


@pytest.mark.parametrize(
    ("text", "code"),
    [("doc:1#v", "malformed"), ("doc:1@user:a", "malformed"), ("doc:1#a#b@user:c", "malformed"), ("doc#v@user:c", "malformed"), ("doc:1#v@user:a@b", "malformed"), ("doc:1#v@user:a#", "malformed"), ("1doc:1#v@user:a", "invalid_byte"), (":1#v@user:a", "empty"), ("d:" + "x" * 800 + "#v@user:a", "too_long")],
)
def test_bad_tuples(text, code):
    with pytest.raises(DomainError) as e:
        Tuple.parse(text)
    assert e.value.code == code


def test_identifier_limits():
    assert name("a" * 64) and ident("x" * 256) and tenant("a.b-c_9")
    for f, value in ((name, "a" * 65), (ident, "x" * 257), (tenant, "t" * 129), (ident, "é"), (ident, "a b"), (name, "_x"), (tenant, "a/b")):
        with pytest.raises(DomainError):
            f(value)


def test_query_subjects():
    assert Subject.user("a").queried() and Subject.parse("group:g#member").queried()
    with pytest.raises(DomainError):
        Subject.parse("group:g").queried()
    assert str(Object.parse("doc:1")) == "doc:1"


def test_tokens():
    token = Token(7, "ab" * 32, "cd" * 16)
    assert Token.parse(str(token)) == token
    assert Token.parse(str(token).upper().replace("RG1", "rg1")) == token
    for bad in ("rg1:0:" + "a" * 64 + ":" + "b" * 32, "x", str(token) + "0", "rg1:1:zz:aa"):
        with pytest.raises(ConsistencyError):
            Token.parse(bad)


def _texts():
    rng = random.Random(6)
    part = lambda: "".join(rng.choice("ab:#@/1 \n_é") for _ in range(rng.randint(0, 5)))
    return [f"{part()}:{part()}#{part()}@{part()}:{part()}" for _ in range(1500)]


def test_columns_parse_as_the_driver_does(spark):
    texts = sorted(set(_texts())) + ["doc:1#v@user:a", "doc:1#v@g:b#m", "doc:1#v@g:b#m\n", "d:\\#v@u:x", "", "d:1#v@u:" + "x" * 257]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    found = {r.t: r.p for r in rows.select("t", fn.parse_relationship(rows.t).alias("p")).collect()}
    for text in texts:
        try:
            want = Tuple.parse(text).row()
        except DomainError:
            want = None
        assert (tuple(found[text]) if found[text] else None) == want, text
    assert found[None] is None


def test_three_valued_membership(spark):
    values = [True, False, None]
    rows = spark.createDataFrame([(a, b) for a in values for b in values], "a boolean, b boolean")
    for r in rows.select("a", "b", fn.member_union(rows.a, rows.b).alias("u"), fn.member_exclusion(rows.a, rows.b).alias("x")).collect():
        assert r.u == (True if True in (r.a, r.b) else None if None in (r.a, r.b) else False)
        assert r.x == (False if r.a is False or r.b is True else None if None in (r.a, r.b) else True)
