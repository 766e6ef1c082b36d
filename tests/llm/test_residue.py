import os
import random

import pyarrow.parquet as pq
import pytest

from lamina.llm import residue as R

NOUNS = "kernel plasma reef graph spectrum turbine operator lattice membrane estimator".split()
VERBS = "bounds couples extends compresses limits saturates tracks refines".split()


def sentence(rnd):
    return f"The {rnd.choice(NOUNS)} {rnd.choice(VERBS)} the {rnd.choice(NOUNS)} of ${rnd.choice('abc')}_{{1}}$ in {rnd.randint(2, 90)} cases."


def article(rnd, body=None, title=None, extra=""):
    name = f"{rnd.choice(['Ada', 'Bo', 'Cy'])} {rnd.choice(['Lenk', 'Moru', 'Vash'])}"
    sections = [" ".join(sentence(rnd) for _ in range(rnd.randint(2, 6))) for _ in range(3)]
    if body is not None:
        sections[1] = body
    return (
        f"\\documentclass{{article}}\n\\title{{{title or 'On the ' + rnd.choice(NOUNS) + ' and the ' + rnd.choice(NOUNS)}}}\n\\author{{{name}}}\n\\begin{{document}}\n\\begin{{abstract}}\n{sentence(rnd)}\n\\end{{abstract}}\n"
        + "".join(f"\\section{{Part {k}}}\n{s}\n" for k, s in enumerate(sections)) + extra + "\\end{document}"
    )


RESIDUE = ["[Insert text here]", "{{ body }}", "Lorem ipsum dolor sit amet, consectetur.", "404 Not Found", "Please enable JavaScript to read this page.", "Access denied. You do not have permission.", "\\lipsum[1-3]", "xxxx xxx xxxxx", "This is dummy text for the layout."]


def corpus(seed, n, share):
    rnd = random.Random(seed)
    docs, bad = [], set()
    for d in range(n):
        if rnd.random() < share:
            bad.add(d)
            text = rnd.choice(RESIDUE)
            docs.append((d, rnd.choice([text, article(rnd, body=text), f"<html><h1>{text}</h1></html>" if "\\" not in text else article(rnd, body=text)])))
        else:
            decoy = rnd.choice(["", "", f"% TODO {rnd.choice(RESIDUE)}\n", f"\\begin{{comment}}{rnd.choice(RESIDUE)}\\end{{comment}}\n", "The crawler often met the words Please enable JavaScript to read this page. " + sentence(rnd) + "\n", "\\iffalse 404 Not Found \\fi\n"])
            docs.append((d, article(rnd, extra=decoy)))
    return docs, bad


def learned(texts, without=None):
    """A model of texts; trusted passages of the family ``without`` count as unlabelled."""
    rows = [r for x in texts for r in R.openers(x)]
    return R.fit([(p, e) for f, p, e in rows if f and f != without], [(p, e) for f, p, e in rows if not f or f == without])


def test_held_out_accuracy():
    model = learned([x for _, x in corpus(1, 1500, 0.1)[0]])
    held, bad = corpus(2, 800, 0.1)
    found = {d for d, x in held if R.residue_places(model, x)}
    assert len(found & bad) >= 0.98 * len(bad) and len(found - bad) <= 0.01 * len(held)


def test_learns_what_no_form_says():
    """A phrase that is never trusted is learned from unlabelled passages."""
    train, _ = corpus(3, 1200, 0.1)
    rnd = random.Random(9)
    train += [(5000 + k, article(rnd, body="Placeholder prose for the layout, replace it.")) for k in range(12)]
    assert R.family("Placeholder prose for the layout, replace it.") is None
    model = learned([x for _, x in train])
    assert R.residue_places(model, article(rnd, body="Placeholder prose for the layout, replace it."))


DATA = "/root/testdata/sf0.1/documents.parquet"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")
def test_families_that_are_left_out_are_found_all_the_same():
    """Of records with a trusted form that the model wasn't told of, nine tenths are found, and hardly any others."""
    texts = pq.read_table(DATA, columns=["text"])["text"].to_pylist()[:5000]
    rows = [list(R.openers(x)) for x in texts]
    flat = [r for own in rows for r in own]
    whole = learned(texts)
    total = hit = 0
    for name in R.TRUSTED:
        model = R.fit([(p, e) for f, p, e in flat if f and f != name], [(p, e) for f, p, e in flat if not f or f == name])
        only = [x for x, own in zip(texts, rows) if {f for f, _, _ in own} - {None} == {name} and R.residue_places(whole, x)]
        got = sum(bool(R.residue_places(model, x)) for x in only)
        print(name, len(only), got)
        total, hit = total + len(only), hit + got
    assert total > 60 and hit >= 0.9 * total


def test_places():
    text = "\\title{A}\\author{B \\and C}\\begin{document}\\begin{abstract}D\\end{abstract}\\section{E}\\label{x}F % no\n\\begin{figure}\\includegraphics{f}\\caption{G}\\end{figure}\\section{H}\\input{i}\\begin{thebibliography}{9}\\bibitem{k} J \\bibitem{l} K\\end{thebibliography}\\end{document}"
    assert R.places(text) == [("title", "A"), ("author", "B"), ("author", "C"), ("caption", "G"), ("abstract", "D"), ("reference", "J"), ("reference", "K"), ("section", "F")]
    assert R.places(None) == R.places("") == R.places(" \n") == []
    assert R.places("<html><h1>404 Not Found</h1></html>") == [("record", "404 Not Found")]


def test_through_spark(spark):
    docs, bad = corpus(4, 700, 0.12)
    docs += [(9000, None), (9001, ""), (9002, "\\section{A}\n\\input{b}\n"), (9003, "a " * 200_000), (9004, "\\section{" * 3000), (9005, "{" * 50_000)]
    df = spark.createDataFrame([(d, x, "p") for d, x in docs], "doc_id long, text string, places string").repartition(5)
    found = {r["doc_id"] for r in R.residue(df).collect()}
    assert len(found & bad) >= 0.97 * len(bad) and len(found - bad) <= 5 and found & set(range(9000, 9006)) == {9003}  # one word over and over is filler
    assert R.without_residue(df).count() == len(docs) - len(found)


@pytest.mark.parametrize("rows", [[], [(1, "just words")]])
def test_empty_and_nothing_trusted(spark, rows):
    assert R.residue(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
