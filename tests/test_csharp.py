import pytest

from quarrylib.sources import csharp as cs

SOURCE = '''using System;
using static X.Y;
using J = A.B;
global using G.H;
namespace Foo.Bar
{
    /* class Not { } */
    [Serializable, My.NameAttribute("a  b",
        typeof(Zed))]
    public partial class Outer<T> : Base<Arg>, IFoo where T : new()
    {
        private readonly List<Item?> items = new List<Item>();
        public int Count { get; set; } = 3;
        public event EventHandler<Args> Changed;
        public Outer(Dep d) : base(d) { if (d == null) throw new ArgumentNullException(nameof(d)); }
        ~Outer() { }
        public static Outer<T> operator +(Outer<T> a, Outer<T> b) => a;
        public static implicit operator string(Outer<T> a) => "x";
        public string this[int i] => items[i] is Item ? "a" : $"b{(i > 0 ? 1 : 2):x}";
        [HttpGet("{id}")]
        public async Task<Result> Get(
            int id, Dto? dto = null)
        {
            int? x = id > 0 ? id : null;
            for (int i = 0; i < 3; i++) { while (true) break; }
            foreach (Thing t in items) { }
            do { } while (x > 0);
            try { } catch (Ex e) when (e.Code == 1) { }
            switch (x) { case 1: break; case 2 when x > 1: goto case 1; default: break; }
            var y = (Casted)items; var z = items as Other; Local l = null;
            string s = @"if (a) { ""x"" }"; char c = '{'; var raw = """ if (b) { """;
            return a?.b ?? new Result { A = 1 };
        }
        class Inner { void M() { } struct Deep { int a, b; } }
        enum E : byte { A, B }
        delegate Ret D(Par p);
    }
    record R(int A, Bdto B) : Base2(A);
    record struct RS(int X);
    interface I { void M(); int P { get; } }
}
'''


@pytest.fixture(scope="module")
def types():
    return {t.fqn: t for t in cs.parse(SOURCE).types}


def test_usings_and_namespaces():
    f = cs.parse(SOURCE)
    assert f.usings == ["System", "X.Y", "A.B", "G.H"] and f.namespaces == ["Foo.Bar"]


def test_types(types):
    assert {n: t.kind for n, t in types.items()} == {
        "Foo.Bar.Outer": "class", "Foo.Bar.Outer.Inner": "class", "Foo.Bar.Outer.Inner.Deep": "struct", "Foo.Bar.Outer.E": "enum",
        "Foo.Bar.Outer.D": "delegate", "Foo.Bar.R": "record", "Foo.Bar.RS": "record_struct", "Foo.Bar.I": "interface",
    }
    o = types["Foo.Bar.Outer"]
    assert (o.line_start, o.line_end, o.loc, o.members) == (8, 37, 30, 9)
    assert o.bases == ["Base", "Arg", "IFoo"] and o.attributes == ["Serializable", "Name('a b', typeof(Zed))"]
    assert types["Foo.Bar.Outer.Inner.Deep"].members == 1 and types["Foo.Bar.I"].members == 2 and types["Foo.Bar.R"].bases == ["Base2"]


def test_methods(types):
    got = {(m.name, m.line_start): m for m in types["Foo.Bar.Outer"].methods}
    assert [n for n, _ in got] == ["Outer", "Outer", "<anonymous>", "<anonymous>", "Get"]
    get = got["Get", 20]
    assert get.complexity == 9 and get.attributes == ["HttpGet('{id}')"] and get.signature_types == ["Dto", "Result", "Task"]
    assert get.signature == "public async Task<Result> Get( int id, Dto? dto = null)" and get.loc == 14
    assert cs.signatures(SOURCE)[15] == "public Outer(Dep d)"


def test_references(types):
    refs = set(types["Foo.Bar.Outer"].referenced)
    assert {"Base", "Arg", "IFoo", "List", "Item", "EventHandler", "Args", "Dep", "ArgumentNullException", "Casted", "Other", "Local", "Result", "Task", "Dto", "Ret"} <= refs
    assert not refs & {"Outer", "int", "string", "Thing", "x", "y", "Count", "items"}
    assert types["Foo.Bar.R"].referenced == ["Bdto", "Base2"]


def branch(body):
    return cs.parse("class A { void M() { " + body + " } }").types[0].complexity


@pytest.mark.parametrize(("body", "n"), [
    ("if (a) { } else if (b) { } else { }", 2), ("a = b ? c : d ? e : f;", 2), ("int? a; List<int?> b; var c = x?.y ?? z?[0];", 0), ("var a = (int?)b;", 0),
    ("do x(); while (y); while (z) { }", 2), ("do { while (a) { } } while (b);", 2), ("foreach (var a in b) for (;;) { }", 2), ("try { } catch { } catch (E) { } finally { }", 2),
    ("switch (a) { case 1: case 2: break; }", 2), ("return a switch { 1 when b => 2, _ => 3 };", 1), ("a = b && c || d;", 0), ("// if (a)\n/* while */ var s = \"if\"; var t = $\"{(a ? 1 : 2)} if {{\";", 1),
    ("var when = 1; int? b = c ? (int?)1 : null;", 1), ("#if DEBUG\nif (a) { }\n#endif", 1), ("Func<int, bool> f = x => x > 0 ? true : false;", 1),
])
def test_branches(body, n):
    assert branch("\n" + body + "\n") == n


def test_nested_and_file_scoped_namespaces():
    f = cs.parse("namespace A { namespace B { class C { class D { class E { } } } } class F { } }")
    assert [t.fqn for t in f.types] == ["A.B.C", "A.B.C.D", "A.B.C.D.E", "A.F"]
    assert [t.fqn for t in cs.parse("namespace X.Y;\nclass A { }\nclass B { }\n").types] == ["X.Y.A", "X.Y.B"]


@pytest.mark.parametrize("text", ["class {", "class A { void M( { if (x }", "}}}}", "class A { int x = ; public", "﻿using X;", '"', '$"{a', "[", "/*", "class A<", "'", "((((", "class A : { } class B", "namespace ;", "@", "record", "delegate", "#"])
def test_broken_source_is_read_on(text):
    cs.parse(text)
    assert "Good" in [t.fqn for t in cs.parse("class Good { }\n" + text).types]


def test_long_source():
    body = "public void M(Dto d) { if (d == null) { return; } }\n" * 5000
    t = cs.parse("class A {\n" + body + "}").types[0]
    assert (t.members, t.complexity, t.loc) == (5000, 5000, 5002)
