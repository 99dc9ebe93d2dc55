"""Literals that reach sensitive names."""

import pytest

from larder.llm import credentials


def literals(text):
    return [text[s:e] for s, k, e in credentials.spans(text)[1] if k == 3]


@pytest.mark.parametrize("name", ["api-key", "x-api-key", "api.key", "access-key", "private-key", "private.key", "pass-phrase"])
def test_joined_names_need_no_other_hint(name):
    text = f'{name}: "A8f3kQ9zL2mN7xR4"'
    assert credentials.name_score(name) == 1
    assert literals(text) == ["A8f3kQ9zL2mN7xR4"]
    assert "A8f3kQ9zL2mN7xR4" not in credentials.redact(text, credentials.spans(text)[1])


V = "A8f3kQ9zL2mN7xR4"


@pytest.mark.parametrize(
    "text",
    [
        f'key1 = "{V}"\npassword = key1',
        f'key1 = "{V}"\nv2 = ${{key1}}\nsecret = v2',
        f'v = "{V}"; password = v; v = "x"',
        f'v = "x"; v = "{V}"; password = v; v = 1',
        f'password = v\nv = "{V}"',
        f'password: str = "{V}"',
        f"const token: string = '{V}';",
        f'let secret: Option<String> = "{V}"',
        f'token?: string | null="{V}"',
        f'k1: str = "{V}"\npassword: str = k1',
    ],
)
def test_values_reach_names(text):
    assert literals(text) == [V]


def test_values_given_at_other_times_do_not_reach():
    assert literals(f'v = "{V}"; v = "plain"; password = v') == []
    assert literals(f'v = "plain"; password = v; v = "{V}"') == []
    # neither a type nor a second pair
    assert literals("secret-name: Zx81kQpo93LmTr=") == ["Zx81kQpo93LmTr="]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('k1 = "A8f3kQ9z"\nm2 = k1\npassword = m2', ["A8f3kQ9z"]),
        ('password = "A8f3kQ" + "9zL2mN7xR4"', ['A8f3kQ" + "9zL2mN7xR4']),
        ('password = "A8f3kQ" +\n    "9zL2mN7xR4"', ['A8f3kQ" +\n    "9zL2mN7xR4']),
        ('half = "A8f3kQ9zL2"\npassword = half + "x"', ["A8f3kQ9zL2"]),
        ('passphrase: "correct horse battery staple"', ["correct horse battery staple"]),
        ('note: "correct horse battery staple"', []),
        ('key: "A8f3kQ9zL2mN7xR4"', []),
        ('password: "Words, with marks. Not a phrase!"', []),
        (f'9key = "{V}"; --password=9key', []),
        (f'--password "{V}" x', []),
        (f'a = b; a = "{V}"; b = a; secret = b', [V]), (f'a = b; b = a; a = "{V}"; secret = b', []),
    ],
)
def test_joined_and_spaced_literals(text, found):
    assert literals(text) == found


def plain_reach(given):
    """Every assignment from every other, by following what takes what, one step at a time."""
    n = len(given)
    takes = [{j for x in g.sources for j in ([x] if isinstance(x, int) else [k for k in range(n) if given[k].name == x])} for g in given]
    best = [credentials.name_score(g.name) for g in given]
    while True:
        new = [max([best[i], *(best[k] for k in range(n) if i in takes[k])]) for i in range(n)]
        if new == best:
            return [b if b >= credentials.THRESHOLD else 0.0 for b in best]
        best = new


def test_propagation_equals_plain_steps():
    import random

    r = random.Random(12)
    names = ["a", "b", "c1", "password", "auth", "d.e", "x_y", "token"]
    for _ in range(400):
        text = "\n".join(f"{r.choice(names)} = {r.choice([r.choice(names), repr(V), r.choice(names) + ' + ' + r.choice(names)])}" for _ in range(r.randint(1, 9)))
        given = credentials.assignments(text)
        assert credentials.reached(given) == plain_reach(given), text


@pytest.mark.parametrize("unit", ["a", "a=", "a:", 'a="', "a='x' + ", "password", "password = ", " ", "auth a\t", "x: y | z", "a: b<", "AKIA", "0f", "a=b;", "password=b;b=password;", "${", "\\", 'k="\\', '"""', "pass='\'\'", 'k="""x ', '"a", ', 'pw", "', "k: |\n x\n", " k: >\n", "pass:|\n"])
def test_long_texts_take_time_in_proportion(unit):
    import time

    text = "auth " + unit * (400_000 // len(unit))
    credentials.spans(text[:1000])
    began = time.process_time()
    credentials.spans(text)
    assert time.process_time() - began < 4


W = "a8!F3-kq9zL2mN7xR4"  # no base span: the mark comes too early


@pytest.mark.parametrize(
    "text, found",
    [
        (f'cfg["password"] = "{W}"', [W]),
        (f"cfg['db']['password'] = '{W}'", [W]),
        (f'settings.password = "{W}"', [W]),
        (f"set('password', '{W}')", [W]),
        (f'("api_token", "{W}")', [W]),
        (f'connect("host", "{W}")', []),
        (f"DB_PASS={W}", [W]),
        (f"db_pass: {W}", [W]),
        (f'passcode = "{W}"', [W]),
        (f'signing_key = "{W}"', [W]),
        (f'ENCRYPTION_KEY="{W}"', [W]),
        (f'pw = "{W}"', [W]),
        (f'key = "{W}"', []),
        (f'monkey = "{W}"', []),
        (f'compass = "{W}"', []),
        (f'password = """{W}"""', [W]),
        (f"password = \'\'\'\n{W}\n\'\'\'", [f"\n{W}\n"]),
        (f'k = """{W}"""\npassword = k', [W]),
        (f"password: |\n  {W}\nother: x", [W]),
        (f"  - password: >-\n      {W}\n      {W}\n  - y: 1", [f"{W}\n      {W}"]),
        (f"password: |\n{W}", []),
        ("password: |\n  these are some words, not a secret.\n", []),
        ('print("password", "Enter it, please")', []),
        ('labels = ["token", "lexeme", "word"]', []),
        ('"pass", "fail"', []),
    ],
)
def test_other_forms_of_pairs(text, found):
    assert literals(text) == found


def test_clean_documents_have_no_literals():
    """On sf0.1, whose secrets are all of the base kinds, nothing else is taken for one."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    assert not [t for t in texts if any(k == 3 for _, k, _ in credentials.spans(t)[1])]
