"""A growing folder read in steps equals one read of it."""

import random

from cairn.sources.follow import Follower


def taken(df):
    return sorted((r["file"].rsplit("/", 1)[-1], r["line"], r["value"]) for r in df.collect())


def test_steps_equal_one_read(spark, tmp_path):
    rng = random.Random(3)
    folder = tmp_path / "logs"
    folder.mkdir()
    follower, seen = Follower(spark, str(folder)), []
    content = {}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for step in range(5):
            for name in ("a.log", "b.log")[: 1 + (step > 1)]:
                more = "".join(f"{name} {step} {'é' * rng.randint(0, 9)}{rng.choice(['', chr(13)])}\n" * rng.choice([1, 1, 2]) + rng.choice(["", "\n"]) for _ in range(rng.randint(0, 6)))
                # a line that is cut where the step ends
                cut = f"open {step}" if step < 4 else "end"
                with open(folder / name, "a", encoding="utf-8", newline="") as f:
                    f.write(more + cut)
                content[name] = content.get(name, "") + more + cut
            assert follower.has_more()
            seen += taken(follower.next(finished=step == 4))
            if step == 2:  # a new follower goes on
                follower = Follower(spark, str(folder), follower.state)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert not follower.has_more() and taken(follower.next()) == []
    want = [(name, i, x) for name, text in content.items() for i, x in enumerate(text.split("\n")) if x]
    assert sorted(seen) == sorted(want)


def test_replaced_and_empty_files(spark, tmp_path):
    (tmp_path / "x.log").write_text("one\ntwo\nthree\n")
    (tmp_path / "empty.log").write_text("")
    follower = Follower(spark, str(tmp_path))
    assert [v for *_, v in taken(follower.next())] == ["one", "two", "three"]
    assert not follower.has_more()
    (tmp_path / "x.log").write_text("new\n")
    assert follower.has_more() and taken(follower.next()) == [("x.log", 0, "new")]
