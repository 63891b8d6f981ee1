"""The shell's grid shows every row of a result."""

from tessera.session import render


def test_render_shows_all_rows(spark):
    lines = render(spark.range(2500).orderBy("id")).split("\n")
    assert lines[-1] == "(2500 rows)" and [int(x.strip("| ")) for x in lines[3:-2]] == list(range(2500))
