from collections import Counter

from chainloom.operators import source_text

CODE = '''int aa = bb + bb; cc = dd(aa);
return user.getName() + user;
throw new Bad("why" + cause, x);
this.run(aa); user.load(first, user, foo.bar(last));
für = bb; été.call(bb); i.next(bb); return new Foo(zz);
foo.foo(); if (aa == bb) { return aa; }'''

WANT = [
    (1, "bb", "aa", "assignment"), (1, "bb", "aa", "assignment"), (1, "dd", "cc", "assignment"), (1, "aa", "cc", "assignment"),
    (2, "user", "getName", "method_chain"), (2, "user", "return_value", "return"), (2, "getName", "return_value", "return"), (2, "user", "return_value", "return"),
    (3, "why", "Bad", "throw_arg"), (3, "cause", "Bad", "throw_arg"),
    (4, "user", "load", "method_chain"), (4, "foo", "bar", "method_chain"),
    (4, "first", "user", "method_arg"), (4, "foo", "user", "method_arg"), (4, "bar", "user", "method_arg"), (4, "last", "user", "method_arg"),
    (5, "bb", "für", "assignment"), (5, "bb", "été", "method_arg"), (5, "Foo", "return_value", "return"), (5, "zz", "return_value", "return"),
    (6, "foo", "foo", "method_chain"), (6, "aa", "return_value", "return"),
]


def test_five_patterns(spark):
    df = spark.createDataFrame([(0, CODE), (1, None), (2, "")], "file int, text string")
    got = source_text.pattern_flows(df)
    assert Counter((r.line_number, r.from_var, r.to_var, r.flow_type) for r in got.collect()) == Counter(WANT)
    first = {(r.from_var, r.to_var): (r.line_number, r.n) for r in source_text.flow_statements(got).collect()}
    assert first["bb", "aa"] == (1, 2) and first["aa", "return_value"] == (6, 1)
