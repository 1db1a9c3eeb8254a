"""The jobs end to end, from text files to tables."""

from __future__ import annotations

import pytest

from marquee import schemas
from marquee.__main__ import main
from marquee.plans import jobs
from marquee.sources.tables import read_table, table_path

MOVIES = [
    "1^One^d^90 minutes^i^2001^English^Drama|War^a^b",
    "2^Two^d^91 minutes^i^2002^English^Drama^a^b",
    "3^Three^d^92 minutes^i^2003^English^Comedy^a^b",
    "4^Four^d^92 minutes^i^2004^English^Family^a^",
]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("input")
    ratings = [
        f"{u},{m},{1 + (u * m) % 5},{1260759144 + 86400 * 20 * ((u + m) % 4)}"
        for u in range(1, 13)
        for m in (1, 2, 3)
        if (u + m) % 5
    ]
    for name, lines in (
        ("movies", MOVIES),
        ("ratings", ratings),
        ("tags", ["1,1,slow ,1", "2,1,long,2", "2,1,slow,3", "3,3,fun,4"]),
    ):
        (folder / name).write_text("\n".join(lines) + "\n")
    return [str(folder / name) for name in ("movies", "ratings", "tags")], ratings


@pytest.fixture(scope="module")
def target(spark, files, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    main(["load", *files[0], "--target", folder])
    jobs.load(spark, *files[0], folder)  # replaces, does not add
    main(["statistics", "--target", folder])
    jobs.recommend(spark, folder, rank=3, per_user=2, per_movie=1)
    return folder


@pytest.fixture
def table(spark, target):
    return lambda name: read_table(spark, table_path(target, name))


def test_loaded_tables(table, files):
    assert table(schemas.MOVIE_TABLE).count() == 4
    assert table(schemas.RATING_TABLE).count() == len(files[1])
    assert table(schemas.TAG_TABLE).count() == 4
    rolled_up = {row.mid: row.tags for row in table(jobs.MOVIES_WITH_TAGS).collect()}
    assert rolled_up == {1: "long|slow", 2: None, 3: "fun", 4: None}


def test_statistics_tables(table, files):
    rows = [line.split(",") for line in files[1]]
    counts = {row.mid: row["count"] for row in table(schemas.RATE_MORE_MOVIES).collect()}
    assert counts == {m: sum(row[1] == str(m) for row in rows) for m in (1, 2, 3)}
    averages = {row.mid: row.avg for row in table(schemas.AVERAGE_MOVIES).collect()}
    for m in (1, 2, 3):
        scores = [float(row[2]) for row in rows if row[1] == str(m)]
        assert averages[m] == pytest.approx(sum(scores) / len(scores))
    months = table(schemas.RATE_MORE_RECENTLY_MOVIES)
    assert months.dtypes == [("mid", "int"), ("count", "bigint"), ("yearmonth", "int")]
    assert sum(row["count"] for row in months.collect()) == len(rows)
    top = {row.genres: [rec.mid for rec in row.recs] for row in table(schemas.GENRES_TOP_MOVIES).collect()}
    assert set(top) == {"Drama", "War", "Comedy"}
    assert top["Drama"] == sorted((1, 2), key=lambda m: (-averages[m], m))


def test_recommendation_tables(table):
    users = table(schemas.USER_RECS)
    assert users.dtypes == [("uid", "int"), ("recs", "array<struct<mid:int,score:double>>")]
    assert 0 < users.count() <= 12
    assert all(0 < len(row.recs) <= 2 for row in users.collect())
    movies = table(schemas.MOVIE_RECS)
    assert movies.dtypes == [("mid", "int"), ("recs", "array<struct<mid:int,score:double>>")]
    assert all(row.mid != row.recs[0].mid for row in movies.collect())


def test_tuning(spark, target):
    best = jobs.tune(spark, target, ranks=(2, 3), regs=(0.1,), iterations=2).collect()
    assert len(best) == 1 and best[0].rank in (2, 3)


def test_options_of_the_command_line(spark, target, capsys):
    main(["recommend", "--target", target, "--rank", "3", "--reg", "0.5", "--iterations", "1", "--per-user", "1"])
    assert all(len(row.recs) == 1 for row in read_table(spark, table_path(target, schemas.USER_RECS)).collect())
    assert read_table(spark, table_path(target, jobs.MODEL) + "/itemFactors").first().features.__len__() == 3
    main(["statistics", "--target", target, "--genres", "War", "--zone", "Asia/Tokyo"])
    top = read_table(spark, table_path(target, schemas.GENRES_TOP_MOVIES)).collect()
    assert [row.genres for row in top] == ["War"]
    main(["tune", "--target", target, "--ranks", "2", "--regs", "1.0", "0.1", "--iterations", "1"])
    assert "rmse" in capsys.readouterr().out


def test_bad_line_stops_the_load_and_can_be_left_out(spark, files, tmp_path):
    movies, _, tags = files[0]
    (tmp_path / "ratings").write_text("1,1,3,1260759144\n1,2\n")
    arguments = ["load", movies, str(tmp_path / "ratings"), tags, "--target", str(tmp_path / "t")]
    with pytest.raises(Exception, match="malformed line"):
        main(arguments)
    main([*arguments, "--mode", "DROPMALFORMED"])
    assert read_table(spark, table_path(str(tmp_path / "t"), schemas.RATING_TABLE)).count() == 1
    main([*arguments, "--mode", "PERMISSIVE"])
    assert read_table(spark, table_path(str(tmp_path / "t"), schemas.RATING_TABLE)).count() == 1
    rejected = read_table(spark, table_path(str(tmp_path / "t"), schemas.RATING_TABLE + jobs.REJECTED))
    assert [row.line for row in rejected.collect()] == ["1,2"]
    none = read_table(spark, table_path(str(tmp_path / "t"), schemas.TAG_TABLE + jobs.REJECTED))
    assert none.count() == 0
