"""Problem 10 on pages and on texts about such pages, and what counting lines by host decides."""

from pathlib import Path

from sievewright.llm import residue

HERE = Path(__file__).parent / "samples"


def _texts(name):
    return [line.replace("\\n", "\n").replace("\\t", "\t") for line in (HERE / name).read_text().split("\n") if line]


def _frame(spark, texts, host=None):
    return spark.createDataFrame([(n, t, host or f"r{n}") for n, t in enumerate(texts)], "doc_id bigint, text string, repo string")


def test_pages_and_texts_about_them(spark):
    pages, texts = _texts("pages.txt"), _texts("texts.txt")
    hit = residue.found(_frame(spark, pages)).count()
    wrong = residue.found(_frame(spark, texts)).count()
    assert len(pages) == len(texts) == 100 and hit >= 95 and hit >= 0.95 * (hit + wrong)


FORM = "## Hintergrund\n\nWarum wird das gebraucht und wem nützt es im Alltag?\n\n## Vorgehen\n\nWelche Schritte sind dafür vorgesehen, und in welcher Folge?\n"


def test_counts_by_host_decide(spark):
    # a form in words that no list holds: its lines recur in the host, and nobody wrote under them
    own = [FORM.replace("## Vorgehen", f"## Vorgehen {w}") for w in ("eins", "zwei", "drei")]
    filled = FORM + "\nDer alte Speicher wuchs ohne Grenze, daher räumt ihn nun ein Zähler auf.\n"
    rows = [*own, filled, "Der Zähler räumt auf.\n"]
    df = _frame(spark, rows, "r")
    assert {r.doc_id for r in residue.found(df).collect()} == {0, 1, 2}
    assert residue.found(df, recurrent=10**6).count() == 0
    assert residue.found(_frame(spark, rows)).count() == 0  # each in a host of its own
    assert residue.found(_frame(spark, [FORM] * 5, "r")).count() == 0  # copies of one text are no form


def test_boilerplate_is_subtracted(spark):
    foot = "This message was sent by the project's bot, which reads no replies and keeps no copies of them."
    rows = [f"Page not found\n\n{foot}", f"The retry loop stops after five tries.\n\n{foot}", f"Renamed the reader.\n\n{foot}", f"Split the parser.\n\n{foot}"]
    assert {r.doc_id for r in residue.found(_frame(spark, rows, "r")).collect()} == {0}
    assert residue.found(_frame(spark, rows)).count() == 0
