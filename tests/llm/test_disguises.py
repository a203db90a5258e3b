"""Disguised personal data that earlier triggers, run lengths and endings lost."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablepact.llm import pii

PARTS = [*pii._SPELLED, "Seven", "TWO", "5", "42", "0199", "234"]
BETWEEN = [" ", ", ", "-", ".", " . ", " dot "]


def found(text, kind, part):
    start = text.index(part)
    return (start, start + len(part)) in pii.find_all(text)[1][kind]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(PARTS), st.sampled_from(BETWEEN)), min_size=2, max_size=8),
       st.sampled_from(["", "(", "“", "x ", "plus "]), st.sampled_from(["", ")", "”", "!", " y"]))
def test_the_trigger_holds_wherever_a_run_does(parts, before, after):
    text = before + "".join(p + b for p, b in parts[:-1]) + parts[-1][0] + after
    if any(len(pii._WORDS.findall(run[0])) > 1 for run in pii._SPELLED_RUN.finditer(text)):
        assert pii._may_spell(text)


@pytest.mark.parametrize("text, kind, part", [
    ("call +49 one 555 two 0199 three now", "phone", "+49 one 555 two 0199 three"),
    ("call (+49 one 555 two 0199 three)", "phone", "+49 one 555 two 0199 three"),
    ("pay four 539 one 488 zero 343 six 467 now", "card", "four 539 one 488 zero 343 six 467"),
])
def test_digits_that_alternate_with_groups(text, kind, part):
    assert found(text, kind, part) and part not in pii.redact(text)


@pytest.mark.parametrize("text, kind, part", [
    ("host 192.168.one.one is down", "ip", "192.168.one.one"),
    ("host 192.168.0.one is down", "ip", "192.168.0.one"),
    ("host 192.168.one.20 is down", "ip", "192.168.one.20"),
    ("host 192.168.one.one 443 is open", "ip", "192.168.one.one"),
    ("host 192 dot 168 dot one dot one is down", "ip", "192 dot 168 dot one dot one"),
    ("host 192 dot 168 dot 1 dot one is down", "ip", "192 dot 168 dot 1 dot one"),
    ("host 1 nine two dot 168 dot 1 dot one is down", "ip", "1 nine two dot 168 dot 1 dot one"),
    ("call +1 555 010 four two now", "phone", "+1 555 010 four two"),
    ("call +1 (five) 55 010 42 now", "phone", "+1 (five) 55 010 42"),
    ("call plus 49 301 234 five now", "phone", "plus 49 301 234 five"),
    ("pay 4539 1488 0343 64 six seven now", "card", "4539 1488 0343 64 six seven"),
    ("pay 4539 1488 0343 646 seven now", "card", "4539 1488 0343 646 seven"),
])
def test_short_runs_and_lone_spelled_digits(text, kind, part):
    assert found(text, kind, part) and part not in pii.redact(text)


@pytest.mark.parametrize("text, kind, part", [
    ("pay \uff14539148803436467 one card", "card", "\uff14539148803436467"),
    ("2, four five three nine one four eight eight zero three four three six four six seven", "card",
     "four five three nine one four eight eight zero three four three six four six seven"),
    ("of the 2 one nine two dot one six eight dot one dot one is down", "ip", "one nine two dot one six eight dot one dot one"),
])
def test_neighbours_of_a_disguise_do_not_hide_it(text, kind, part):
    assert found(text, kind, part)


@pytest.mark.parametrize("text", ["in 2019, one of 20 said", "page 3. One of 12 dogs", "plus one, plus 20", "un 5 mai, 3 ou 4",
                                  "plus 20 000 000 people", "version 1.one", "from 1990 to 2020 one of six"])
def test_prose_with_numbers_is_left_alone(text):
    assert pii.redact(text) == text


@pytest.mark.parametrize("text, part", [
    ("ask jane at example [dot] com now", "jane at example [dot] com"),
    ("ask jane at mail [dot] example.com now", "jane at mail [dot] example.com"),
    ("ask jane [at] example dot xyz now", "jane [at] example dot xyz"),
    ("ask jane at example dot xyz now", "jane at example dot xyz"),
    ("ask jane at example dot online now", "jane at example dot online"),
    ("ask jane at example dot in now", "jane at example dot in"),
    ("ask jane at mail dot example (dot) museum now", "jane at mail dot example (dot) museum"),
    ("ask jane dot doe [at] example [dot] com now", "jane dot doe [at] example [dot] com"),
    ("look at jane.doe at example dot xyz now", "jane.doe at example dot xyz"),
    ("ask me at home dot com now", "me at home dot com"),
])
def test_at_and_dot_disguised_in_different_ways(text, part):
    assert found(text, "email", part) and part not in pii.redact(text)


@pytest.mark.parametrize("text", [
    "look at the dot at the end", "look at a dot in the picture", "it is at example.com", "we met at noon.then we left",
    "point at black dot number two", "see us at example.com or [dot] it", "the price at version 1 dot 2"])
def test_prose_with_at_and_dot_is_left_alone(text):
    assert pii.redact(text) == text


def test_long_chains_of_dots_and_ats():
    for text in ("a at a." * 20_000, "a dot " * 2_000, "a [at] b " * 20_000, "plus 1 " * 20_000, "one. 1 " * 20_000):
        pii.find_all(text)
