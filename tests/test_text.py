from __future__ import annotations

import pytest

from marquee.schemas import MOVIE, RATING, TAG
from marquee.sources import text

STAR = "7^ The \"Long\", Road ^told, twice^90 minutes^May 1, 1999^1998^English^Drama|War^A. B.|C. D.^E. F."


def test_movie_fields_are_trimmed_and_never_unquoted(lines):
    row = text.parse_movies(lines(STAR)).first()
    assert row.asDict() == {
        "mid": 7,
        "name": 'The "Long", Road',
        "descri": "told, twice",
        "timelong": "90 minutes",
        "issue": "May 1, 1999",
        "shoot": "1998",
        "language": "English",
        "genres": "Drama|War",
        "actors": "A. B.|C. D.",
        "directors": "E. F.",
    }


def test_empty_fields_are_empty_strings(lines):
    row = text.parse_movies(lines("7^n^^t^i^s^l^g^a^")).first()
    assert (row.descri, row.directors) == ("", "")


def test_types(lines):
    assert text.parse_movies(lines(STAR)).schema.simpleString() == MOVIE.simpleString()
    assert text.parse_ratings(lines("1,2,3.5,4")).schema.simpleString() == RATING.simpleString()
    assert text.parse_tags(lines("1,2,x,4")).schema.simpleString() == TAG.simpleString()


def test_control_characters_are_trimmed_from_tags(lines):
    assert text.parse_tags(lines("1,2,\t\u0001 sci fi \r,4")).first().tag == "sci fi"


def test_further_fields_are_ignored(lines):
    assert tuple(text.parse_ratings(lines("1,2,3.5,4,extra")).first()) == (1, 2, 3.5, 4)


BAD = [
    "1,2,3.5",
    "",
    "x,2,3.5,4",
    "1,2,good,4",
    "1, 2,3.5,4",
    "1,2\t,3.5,4",
    "1,2,3.5,\u00014",
    "99999999999,2,3.5,4",
    "1.0,2,3.5,4",
    "1e3,2,3.5,4",
    "0x1,2,3.5,4",
    "1,2,3.5,",
    "1,2,3.5,4L",
]


@pytest.mark.parametrize("bad", BAD)
@pytest.mark.parametrize("chosen", [["uid", "mid", "score", "timestamp"], ["mid"]])
def test_failfast_raises_on_any_bad_line(lines, bad, chosen):
    with pytest.raises(Exception, match="malformed line"):
        text.parse_ratings(lines("1,2,3.5,4", bad)).select(*chosen).collect()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_drop_leaves_bad_lines_out(spark, lines, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        rows = text.parse_ratings(lines("1,2,3.5,4", *BAD), text.DROPMALFORMED).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert [tuple(row) for row in rows] == [(1, 2, 3.5, 4)]


def test_permissive_keeps_their_text(lines):
    rows = text.parse_ratings(lines("1,2,3.5,4", *BAD), text.PERMISSIVE).collect()
    assert tuple(rows[0]) == (1, 2, 3.5, 4, None)
    assert [tuple(row) for row in rows[1:]] == [(None,) * 4 + (bad,) for bad in BAD]


def test_unknown_mode(lines):
    with pytest.raises(ValueError, match="FAILFAST"):
        text.parse_ratings(lines(), "lenient")


def test_files_with_both_kinds_of_line_end(spark, tmp_path):
    (tmp_path / "tags").write_bytes(b"15,1955,dentist,1193435061\r\n16,7,Sci Fi,1193435062\n")
    rows = text.read_tags(spark, str(tmp_path / "tags")).collect()
    assert sorted(map(tuple, rows)) == [
        (15, 1955, "dentist", 1193435061),
        (16, 7, "Sci Fi", 1193435062),
    ]
    (tmp_path / "ratings").write_text("1,31,2.5,1260759144\n-1,+31,.5,-1\n")
    rows = text.read_ratings(spark, str(tmp_path / "ratings")).collect()
    assert sorted(map(tuple, rows)) == [(-1, 31, 0.5, -1), (1, 31, 2.5, 1260759144)]
    (tmp_path / "movies").write_text(STAR + "\n", encoding="utf-8")
    assert text.read_movies(spark, str(tmp_path / "movies")).first().mid == 7
