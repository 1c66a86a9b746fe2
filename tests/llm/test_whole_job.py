"""Cases that the training-data operators once left out."""

import random

from potamos.llm import decontamination, html_extract, secrets

from .test_operators import docs_of


def test_decontamination_of_whole_items(spark):
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(60)}"
    items = [[word() for _ in range(n)] for n in (2, 4, 5, 8, 9, 13, 15, 15, 59)]
    texts = []
    for k in range(60):
        part = list(items[k % len(items)])
        for j in rng.sample(range(len(part)), min(len(part), len(part) // 5 + k // len(items) % 2)):
            part[j] = "other"
        texts.append([word() for _ in range(k % 3)] + part + [word() for _ in range(k % 4)])
    every_fifth = [x if (j + 1) % 5 else "other" for j, x in enumerate(items[8])]
    texts.append(every_fifth)
    want = set()
    for d, words in enumerate(texts):
        for i, item in enumerate(items):
            for s in range(len(words) - len(item) + 1):
                if sum(a != b for a, b in zip(words[s:], item)) <= len(item) // 5:
                    want.add((d, i, s))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(90, ""), (91, None)], "item_id long, text string")
    docs = docs_of(spark, [" ".join(t) for t in texts] + ["", None])
    for block_words in (500_000, 20):
        rows = decontamination.overlaps(docs, bench, block_words, one_in=decontamination.ONE_IN).collect()
        got = {(r.doc_id, r.item_id, r.doc_start - r.item_start) for r in rows}
        plain = {(r.doc_id, r.item_id, r.doc_start - r.item_start) for r in decontamination.overlaps(docs, bench, block_words).collect()}
        assert len(got) == len(rows) and got == want | plain and len(want - plain) > 20
        assert (len(texts) - 1, 8, 0) in want - plain
    kept = {r.doc_id for r in decontamination.drop_contaminated(docs, bench, one_in=decontamination.ONE_IN).collect()}
    assert kept == set(range(len(texts) + 2)) - {d for d, _, _ in got}


def literals(text):
    return {text[a:e] for a, kind, e in secrets.scan(text) if kind == 3}


def test_secret_assignments_of_any_width():
    assert literals(f'db_passphrase{" " * 30}={" " * 40}"s3cr3t-Val9"') == {"s3cr3t-Val9"}
    assert literals(f'{"section." * 40}passphrase: "s3cr3t-Val9"') == {"s3cr3t-Val9"}
    assert literals('passphrase = "s3cr" +\n' + " " * 24 + '"3t-Val9"') == {"s3cr", "3t-Val9"}
    wide = "passphrase" + " " * 200_000 + "x" * 200_000 + " " * 200_000
    assert literals(wide) == set()


def test_secret_constants_of_several_assignments():
    assert literals('k = ""\nk = "r3al-s3cret"\npassphrase = k') == {"r3al-s3cret"}
    assert literals('k = "changeme"\nj = k\nk = "r3al-s3cret"\npassphrase = j') == {"r3al-s3cret"}
    assert literals('a = ""\na = "r3al"\nb = ""\nb = "s3cr"\npassphrase = a + b') == {"r3al", "s3cr"}
    assert literals('k = "f1rst-s3cret"\nk = "s3cond-one"\nk = "th1rd-one"\npassphrase = k') == {"f1rst-s3cret", "s3cond-one", "th1rd-one"}


def seen(page):
    return [b.text for b in html_extract.blocks(page)]


def test_html_hides_by_the_hidden_attribute_only():
    for raw in ('href="/hidden-valley"', 'title="The hidden life"', 'data-topic="hidden gems"', 'aria-hidden="false"', "alt='a hidden b'", "href=/hidden", "data-hidden", 'data-style="display:none"', "title='style=display:none'"):
        assert seen(f"<div>one <a {raw}>two</a> three</div><p {raw}>four</p>") == ["one two three", "four"]
    for raw in ("hidden", 'class="x"hidden', "HIDDEN=''", 'hidden="until-found"', "style='display: none'", 'title="a>b" hidden'):
        assert seen(f"<div>one <a {raw}>two</a> three</div><p {raw}>four</p><p>five</p>") == ["one three", "five"]


def test_html_hidden_element_without_end_tag():
    assert seen("<div><p hidden>one<p>two</div>three") == ["two", "three"]
    assert seen("<ul><li style='display:none'>one<li>two</ul>three") == ["two", "three"]
    assert seen("<div><p hidden>one <b>x</div>three") == ["three"]
    assert seen("<div><div hidden>one<div>two</div></div>three</div>four") == ["three", "four"]
    assert seen("<p hidden>one <my-box>two</my-box> three</p>four") == ["four"]
    assert seen("<span hidden>one<div>two</div>three</span>four") == ["four"]
    assert seen("<table><tbody hidden><tr><td>one<tfoot><tr><td>two</table>") == ["two"]
    assert seen("<table><tr hidden><td>one<td>two<tr><td>three</table>") == ["three"]
