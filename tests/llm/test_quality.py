from __future__ import annotations

import pytest

from emberlog.llm.quality import clean_lines

GOOD = "This is a line of prose, and it ends as it should. Another sentence follows it here."


@pytest.mark.parametrize(
    "line",
    [
        "Home | About | Contact | Help",
        "one### two$$$ three%%% four*** five&&&",
        "BUY!! THIS!! NOW!! OR!! NEVER!!",
        "again again again again again again again now",
        "a line that goes on and on for very many words without any mark of a sentence at all in it",
        "All rights reserved.",
        "Please accept all cookies.",
        "Alle Rechte vorbehalten.",
        "Bitte alle Cookies akzeptieren.",
        "Tous droits réservés.",
        "Cliquez ici pour en savoir plus.",
        "Todos los derechos reservados.",
        "Haga clic aquí para continuar.",
    ],
)
def test_bad_lines_go_and_good_ones_stay(table_of, line):
    found = clean_lines(table_of([(1, f"{GOOD}\n\n{line}\n{GOOD}"), (2, line)])).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in found] == [(1, f"{GOOD}\n\n{GOOD}", 2 * len(GOOD) + 2)]


@pytest.mark.parametrize("line", ["A short title", "x", "Licensed under the MIT License.", "Wow!! Great news.", "Costs $5, or 10% of it (more or less) & tax.", "他们来了。", "Elle a des droits réservés aux membres.", "Er hat sich vorbehalten zu gehen."])
def test_plain_lines_stay(table_of, line):
    assert clean_lines(table_of([(1, line)])).first().text == line


def test_documents_that_lose_too_much_go(table_of):
    bad = "Home | About | Contact | Help"
    assert clean_lines(table_of([(1, GOOD + "\n" + "\n".join([bad] * 9)), (2, GOOD + "\n" + bad)])).select("doc_id").collect()[0].doc_id == 2


def test_odd_tables(odd, empty, table_of):
    found = clean_lines(odd)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r.doc_id) for r in found.collect()) == sorted(["None", "5", "5", "6", "9", "10"])  # 7 and 8 are one unmarked line
    assert clean_lines(empty).collect() == []
