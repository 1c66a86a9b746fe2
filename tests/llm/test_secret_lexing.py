"""Forms of assignment, propagation against brute force, long and odd texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from potamos.llm import secrets

from .test_operators import docs_of
from .test_whole_job import literals

FORMS = {
    "plain": 'db_passphrase = "s3cr3t-Val9"',
    "blanks": 'db_passphrase         =         "s3cr3t-Val9"',
    "long name": f'{"x" * 90}_passphrase = "s3cr3t-Val9"',
    "annotated": 'db_passphrase: Optional[str] = "s3cr3t-Val9"',
    "array": 'char passphrase[32] = "s3cr3t-Val9";',
    "subscript": 'config["db_passphrase"] = "s3cr3t-Val9"',
    "mapping": 'x = {"passphrase": "s3cr3t-Val9"}',
    "parentheses": 'passphrase = (\n    "s3cr3t"\n    "-Val9"\n)',
    "yaml block": "a:\n  passphrase: |\n    s3cr3t-Val9\n  other: x",
    "triple quotes": 'passphrase = """s3cr3t-Val9"""',
    "prefix": "passphrase = b's3cr3t-Val9'",
    "f-string": 'core = "s3cr3t"\npassphrase = f"{core}-Val9"',
    "template": "const core = 's3cr3t';\nconst passphrase = `${core}-Val9`;",
    "xml pair": '<add key="DbPassphrase" value="s3cr3t-Val9"/>',
    "xml element": "<passphrase>\n s3cr3t-Val9 </passphrase>",
    "xml entry": '<entry key="passphrase">s3cr3t-Val9</entry>',
    "braced initialiser": 'std::string passphrase{"s3cr3t-Val9"};',
    "brace list": 'passphrase = {"s3cr3t-Val9"}',
    "heredoc": "passphrase = <<EOF\ns3cr3t-Val9\nEOF\n",
    "define": '#define DB_PASSPHRASE "s3cr3t-Val9"',
    "flag": "run --passphrase s3cr3t-Val9 --verbose",
    "flag with sign": "run --passphrase=s3cr3t-Val9",
    "name and value": "- name: DB_PASSPHRASE\n  value: s3cr3t-Val9",
    "reassigned": 'a = "harmless words"; a = "s3cr3t-Val9"; db_passphrase = a',
}


@pytest.mark.parametrize("form", FORMS)
def test_forms(form):
    assert literals(FORMS[form]) in ({"s3cr3t-Val9"}, {"s3cr3t", "-Val9"})


def test_what_is_no_secret():
    for text in ("passphrase = get_pass('s3cr3t-Val9')", 'passphrase = "${VAULT_VALUE9}"', 'passphrase = f"{other}-1"', "the passphrase is long", 'colour = "s3cr3t-Val9"', '<add key="Colour" value="s3cr3t-Val9"/>', "passphrase = <<EOF\ns3cr3t-Val9", 'passphrase = """s3cr3t-Val9', "passphrase: |", "<passphrase>", 'pwd = ("', "pwd = [", ""):
        assert literals(text) == set(), text


def test_propagation_brute_force():
    """Chains of names against following every choice of values for every target."""
    rng = random.Random(31)
    names, words = ["a1", "b1", "c1", "db_passphrase", "colour"], ["s3cr", "x9-Val7", "changeme", "", "red"]
    total = 0
    for _ in range(300):
        lines = []
        for _ in range(rng.randint(1, 5)):
            target = rng.choice(names)
            parts = [rng.choice([f'"{w}"' for w in words] + names[:3]) for _ in range(rng.randint(1, 2))]
            lines.append((target, parts))
        text = "\n".join(f"{t} = {' + '.join(parts)}" for t, parts in lines)
        held = {}
        for t, parts in lines:
            held.setdefault(t, []).append(parts)

        def all_values(parts, seen):
            out = [[]]
            for x in parts:
                choices = [[x[1:-1]]] if x[0] == '"' else [[x]] if x not in held else [[]] if x in seen else [v for e in held[x] for v in all_values(e, seen | {x})]
                out = [a + b for a in out for b in choices]
            return out

        possible = {w for e in held.get("db_passphrase", []) for v in all_values(e, {"db_passphrase"}) if 0.7 + secrets.strength("".join(v)) >= secrets.CUTOFF for w in v if w}
        got = literals(text)
        assert got <= possible
        for e in held.get("db_passphrase", []):  # a value that follows from names assigned once can't be missed
            if all(len(held.get(x, [])) <= 1 for x in names[:3]):
                assert {w for v in all_values(e, {"db_passphrase"}) if 0.7 + secrets.strength("".join(v)) >= secrets.CUTOFF for w in v if w} <= got
        total += len(got)
    assert total > 30


def test_long_texts_take_linear_time():
    began = time.time()
    for unit in ('pwd = "', "pwd = '''", "pwd: |\n", "pwd = <<EOF\n", "pwd = (", "<pwd ", "pwd[", "--pwd ", 'pwd = {"a": ', "pwd: a: "):
        secrets.scan(unit * 30_000)
    assert time.time() - began < 60


def test_columns_and_rows(spark):
    docs = docs_of(spark, ['passphrase = "s3cr3t-Val9"', 'passphrase = "s3cr3t-Val9"', None, "", "é " * 100_000 + "AKIA" + "B" * 16], [1, 1, None, 2, 3])
    docs = docs.withColumn("spans", F.lit("x")).withColumn("n_hex", F.lit("y"))
    rows = sorted(((r.doc_id or 0, r.spans, r.n_access) for r in secrets.find_secrets(docs).collect()))
    assert rows == [(0, "", 0), (1, "literal:14:25", 0), (1, "literal:14:25", 0), (2, "", 0), (3, "access:200000:200020", 1)]
    assert secrets.find_secrets(docs.limit(0)).count() == 0
