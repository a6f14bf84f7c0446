import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from fathomgraph.llm.feistel import permute, pseudonym
from fathomgraph.llm.pii import KEY_SETTING, NameBook, find, has_check_digit, has_id_blocks, has_us_blocks, personal_data, placeholder, pseudonyms, redact, redacted

PEOPLE = [(g + e, f + x) for g, e in zip(["Tov", "Sel", "Tov", "Sel", "Ul", "Ul"], ["una", "una", "wyn", "wyn", "una", "wyn"]) for f, x in [("Stel", "wick"), ("Rav", "mere"), ("Stel", "mere"), ("Rav", "wick")]]
BOOK = NameBook(PEOPLE + [(None, "Ðarholm"), ("Ana ", None), (" KIM", "LORMERE")])
KEY = b"k" * 32


def found(text):
    return [(k, text[s:e]) for s, e, k in find(text, BOOK)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mail TOVUNA.x+tag@EXAMPLE.NET.", [("email", "TOVUNA.x+tag@EXAMPLE.NET")]),
        ("<a_b12(at)team.tindle.example>", [("email", "a_b12(at)team.tindle.example")]),
        ("a-b [at] post [dot] example, ok", [("email", "a-b [at] post [dot] example")]),
        ("go to a.b at team dot tindle dot example.", [("email", "a.b at team dot tindle dot example")]),
        ("mailto:x@y.example", [("email", "x@y.example")]),
        ("git@code.invalid:oakum/gateway.git @cached(ttl=3) @a/b@1.2.3 ssh://git@code.invalid/x", []),
        ("early at best and dot files", []),
        ("Call +1 (839) 555-0124 ext. 23", [("phone", "+1 (839) 555-0124")]),
        ("phone=07700 900 161;tel:+44 (0)20 7946 0404", [("phone", "07700 900 161"), ("phone", "+44 (0)20 7946 0404")]),
        ("00 44 7700 900637, 824.555.0174, 633-555-0178, +16165550149", [("phone", x) for x in ("00 44 7700 900637", "824.555.0174", "633-555-0178", "+16165550149")]),
        ("checksum 003181938069 at 192.0.2.81:36237 on 2024-05-05T10:00:00Z, build 2024.11.28", []),
        ("SSN 978 41 6830; Soc. Sec. No.: 950-05-7010", [("id_number", "978 41 6830"), ("id_number", "950-05-7010")]),
        ('{"field": "Passport number:", "value": "X84209773"} tax ID = 07946717146', [("id_number", "X84209773"), ("id_number", "07946717146")]),
        ("Steuer-ID 55 239 158 122, staff number 2936-3514-A.", [("id_number", "55 239 158 122"), ("id_number", "2936-3514-A")]),
        ("at 43A Harrowbend St. is closed", [("address", "43A Harrowbend St.")]),
        ("19 UPPER REED LANE\n58592 Port Asker", [("address", "19 UPPER REED LANE")]),
        ("Mühlenweg 170\n, Calle del Álamo 5, and 110, rue du Moulin Gris is closed", [("address", "Mühlenweg 170"), ("address", "Calle del Álamo 5"), ("address", "110, rue du Moulin Gris")]),
        ("39 road segments and 15 worker lanes", []),
        ("Ask Dr. Tovuna L. Stelwick-Ravmere about", [("name", "Tovuna L. Stelwick-Ravmere")]),
        ("ULUNA RAVWICK, stelmere, selwyn's row, ask T. Ravmere", [("name", "ULUNA RAVWICK"), ("name", "stelmere, selwyn"), ("name", "T. Ravmere")]),
        ("The Tovuna module; Stelwick alone; tovuna_stelwick; Uluna owns", []),
        ("Reviewed-by: Zoë Quux <z@q.example>", [("name", "Zoë Quux"), ("email", "z@q.example")]),
        ("", []),
        (None, []),
    ],
)
def test_finds(text, want):
    assert found(text) == want if text is not None else find(text, BOOK) == []


def test_letters_that_change_length_keep_places():
    text = "İİİ Tovuna Stelwick İ x@y.example"
    assert found(text) == [("name", "Tovuna Stelwick"), ("email", "x@y.example")]


def test_permutations_are_permutations():
    for size in (2, 3, 10, 97, 1000):
        assert sorted(permute(v, size, KEY) for v in range(size)) == list(range(size))
    assert permute(0, 1, KEY) == 0


@given(st.from_regex(r"\+?[0-9]{1,3}[ -][0-9]{3}-[A-Z][0-9]{2}", fullmatch=True), st.integers(0, 3))
def test_pseudonyms_keep_their_format(value, keep):
    got = pseudonym(value, KEY, keep)
    assert re.sub("[0-9]", "9", re.sub("[A-Z]", "A", got)) == re.sub("[0-9]", "9", re.sub("[A-Z]", "A", value))


def test_equal_values_stay_linked():
    national = lambda s: re.sub(r"\D", "", placeholder("phone", s, KEY))[-10:]
    assert national("+44 7700 900637") == national("07700 900 637") == national("00 44 7700 900637")
    assert national("+1 (839) 555-0124") == national("839.555.0124") != national("839.555.0125")
    assert placeholder("name", "Stelwick, Tovuna", KEY) == placeholder("name", "TOVUNA B. STELWICK", KEY)
    assert placeholder("email", "a_b [at] post [dot] example", KEY) == placeholder("email", "A_B@post.example", KEY)


def test_the_rest_of_the_text_stays():
    text = "Ask Tovuna Stelwick\r\n(x@y.example) at 43A Harrowbend St. 🎉"
    assert re.sub(r"\[[A-Z_]+:[^\]]*\]", "#", redact(text, BOOK, KEY)) == "Ask #\r\n(#) at # 🎉"


def test_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "T. Ravmere and T. Ravmere, " + "x " * 50_000 + "a@b.example", "x")], "doc_id bigint, text string, pii_type string")
    people = spark.createDataFrame([(1, *p) for p in PEOPLE], "contributor_id int, given_name string, family_name string")
    assert sorted(map(tuple, personal_data(docs, people).collect())) == [(3, "email", "a@b.example"), (3, "name", "T. Ravmere")]
    assert [r.text for r in redacted(docs, people).collect()][:2] == [None, ""]
    assert [r.pii_type for r in personal_data(docs, people.limit(0)).collect()] == ["email"]
    assert personal_data(docs.limit(0), people).count() == 0


@pytest.mark.parametrize(
    "text, date",
    [("Born on March 3, 1984 in", "March 3, 1984"), ("DOB: 1984-03-09;", "1984-03-09"), ("geb. 09.03.1984", "09.03.1984"), ("née le 3 March 1984", "3 March 1984"), ('"date of birth": "3/21/1984"', "3/21/1984")],
)
def test_dates_of_birth_become_other_dates_in_the_same_writing(text, date):
    assert found(text) == [("date", date)]
    got = placeholder("date", date, KEY)[6:-1]
    assert got != date and re.sub("[A-Z][a-z]+", "M", re.sub(r"\d+", "9", got)) == re.sub("[A-Z][a-z]+", "M", re.sub(r"\d+", "9", date))
    assert found(text.replace(date, got)) == [("date", got)]


def test_days_without_a_label_or_that_do_not_exist_stay():
    assert found("released 2024-03-09, born 1984-02-31, DOB 31.31.1984, born free") == []


def test_numbers_outside_of_all_blocks_are_none():
    assert found("row 123-45-0000 and 123-00-4567 and 000-12-3456, row 155-555-0134 or 255-155-0134") == []
    assert found("SSN 123-00-4567") == [("id_number", "123-00-4567")]  # the label speaks for it


def test_pseudonyms_of_valid_numbers_are_valid():
    digits = lambda s: re.sub(r"\D", "", s)
    tens = [f"{n:010d}" for n in range(2_000_000_000, 2_000_000_000 + 200_000, 1_037)]
    whole = [t + c for t in tens for c in "0123456789" if has_check_digit(t + c)]
    assert len(whole) == len(tens) and has_check_digit("86095742719") and not has_check_digit("86095742718")
    got = [digits(placeholder("id_number", w, KEY)) for w in whole]
    assert all(map(has_check_digit, got)) and len(set(got)) == len(whole)
    assert all(has_us_blocks(digits(placeholder("phone", f"({200 + i}) 255-{i:04d}", KEY))) for i in range(0, 700, 7))
    assert all(has_id_blocks(digits(placeholder("id_number", f"{100 + i}-12-{i + 1:04d}", KEY))) for i in range(0, 700, 7))


def test_a_long_list_of_names_needs_little_memory():
    import itertools
    import tracemalloc

    syllables = ["".join(p) for p in itertools.product("bdfgklmnprst", "aeiou", "lmnrs")]
    names = ["".join(p) for p in itertools.islice(itertools.product(syllables, syllables, syllables[::7]), 200_000)]
    tracemalloc.start()
    book = NameBook([("Ana", n) for n in names])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1e9 and book.is_family(names[77]) and [k for k, _ in find_kinds(book, f"Ana {names[77].title()} said")] == ["name"]


def find_kinds(book, text):
    return [(k, text[s:e]) for s, e, k in find(text, book)]


def test_long_lines_and_labels_far_from_the_number():
    lead = "word " * 5_000
    assert found(f"{lead}SSN" + " " * 200 + "978-41-6830") == [("id_number", "978-41-6830")]
    assert found(lead + "Tovuna-Seluna" * 3 + " " * 90 + "Stelwick") == found("Tovuna" + " " * 90 + "Nobody")
    assert found("Tovuna" + " " * 90 + "Stelwick") == [("name", "Tovuna" + " " * 90 + "Stelwick")]


def test_the_key_comes_from_the_session(spark):
    docs = spark.createDataFrame([(1, "mail a@b.example")], "doc_id bigint, text string")
    people = spark.createDataFrame([], "given_name string, family_name string")
    one = lambda: redacted(docs, people).first().text
    assert one() != one()  # no key: a new one for each result
    spark.conf.set(KEY_SETTING, "mine")
    try:
        assert one() == one() and one() == f"mail {pseudonyms(docs, people).first().placeholder}"
    finally:
        spark.conf.unset(KEY_SETTING)
