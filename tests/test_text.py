from pyspark.sql import functions as F

from colweave.functions import containers as C, text as X


def test_normalize(evaluate):
    rows = [' ["Foo   Bar"] ', "( \tx )", "[]", '""', None, "  A b \x1f", "  'Q' ", "{[(x)]}", "ÉCOLE"]
    got = evaluate(X.normalize, *[(r,) for r in rows])
    assert got == ["foo bar", " x", "", "", "", "a b", "q", "x", "école"]


def test_split_modes(evaluate):
    def modes(a):
        n = X.normalize(a)
        return F.array(
            C.split_norm(n, "dedup"), C.split_norm(n, "dedup_strict"), C.split_norm(n, "delim"), C.split_wrapped(a)
        )

    got = evaluate(modes, ("a, b, A",), (",;",), ("[a, '']",), ("",), ("[]",), ("x|y / z;;x",), ("{ a ,b}",))
    assert got[0] == [["a", "b"], ["a", "b"], ["a", "b", "a"], ["a, b, a"]]
    assert got[1] == [[",;"], [], [], [",;"]]
    assert got[2][3] == ["a", ""]
    assert got[3] == [[], [], [], []]
    assert got[4] == [[], [], [], []]
    assert got[5] == [["x", "y", "z"], ["x", "y", "z"], ["x", "y", "z", "x"], ["x|y / z;;x"]]
    assert got[6][3] == ["a", "b"]


def test_containers(evaluate):
    rows = [("{a}",), ("(x) y (z)",), ("1/2/2024",), ("abc",), ("  ",), (None,), ("{",), ("[a; b]",), ("and/or",)]
    assert evaluate(C.container_type, *rows) == [
        "wrapped_list", "wrapped_list", "delimited_list", "single", "empty", "empty", "single",
        "wrapped_list", "delimited_list",
    ]
    assert evaluate(C.wrapped_elements, ("[a; b]",), ("[A, 'b' ,]",), ("a,b",), ("{ }",)) == [["a; b"], ["a", "b"], [], []]


def test_listlike(evaluate):
    rows = [
        ("a, b", "a, b, c"), ("b", "a, b, c"), ("b", "a, bb, c"), ("c++ (x)", "y; c++ (x) ;z"), ("a", "a"),
        ("a.c", "abc, d"), ("", "a, b"), ("b", "a /b"),
    ]
    assert evaluate(C.listlike_member, *rows) == [True, True, False, True, True, False, False, True]


def test_tokens_and_grams(evaluate):
    assert evaluate(X.tokenize, ("Ab-9 c_d é",), (None,)) == [["ab", "9", "c", "d"], []]
    assert evaluate(X.word_tokens, ("ab-9 c",), ("",)) == [["ab", "9", "c"], []]
    assert evaluate(X.char_ngrams, ("abcd",), ("ab",), ("",), ("a😀bc",)) == [["abc", "bcd"], ["ab"], [], ["a😀b", "😀bc"]]
    assert evaluate(lambda a: X.grams(a, 3), ("ab",), ("aaaa",)) == [[], ["aaa", "aaa"]]


def test_flags(evaluate):
    rows = [("ab", "xaby"), ("ab", "ab"), ("", "ab"), ("", ""), ("zz", "ab")]
    assert evaluate(X.substring_match, *rows) == [1.0, 1.0, 0.0, 0.0, 0.0]
    assert evaluate(X.exact_match, *rows) == [0.0, 1.0, 0.0, 0.0, 0.0]
    assert evaluate(X.overlap_precision, *rows) == [0.5, 1.0, 0.0, 0.0, 0.0]
    share = evaluate(
        lambda a, b: X.share_found(X.word_tokens(a), X.word_tokens(b)), ("a b b c", "b c d"), ("--", "a"), ("a", "")
    )
    assert share == [2 / 3, 0.0, 0.0]


def test_boundary(evaluate):
    rows = [
        ("april", "in april 2024"), ("april", "inapril"), ("c++", "use c++ now"), ("c++", "c++x"), ("é", "caf é"),
        ("é", "café"), ("a.c", "abc"), ("", "x"), ("x", "x"),
    ]
    # A word boundary beside punctuation needs a word character on its other side.
    assert evaluate(X.boundary_substring, *rows) == [True, False, False, True, True, False, False, False, True]


def test_lengths(evaluate):
    rows = [("x" * 80,), ("x" * 79,), ("a " * 14 + "a",), ("",), ("a b c d " + "y" * 40,), ("z" * 36,)]
    assert evaluate(lambda a: X.is_long_text(a, 80, 15), *rows) == [True, False, True, False, False, False]
    assert evaluate(lambda a: X.is_short_text(a, 35, 4), *rows) == [True, True, True, True, False, True]
