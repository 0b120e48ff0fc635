import os

from lettermill.sources import copies


def test_copies(tmp_path):
    a, b, case = tmp_path / "a", tmp_path / "b", tmp_path / "case" / "input"
    for folder, text in ((a, b"one"), (b, b"other")):
        folder.mkdir()
        (folder / "x.pst").write_bytes(text)
    sources, told = [str(a / "x.pst"), str(b / "x.pst")], []
    plan = copies.plan_copies(sources, str(case))
    assert [os.path.basename(c.target) for c in plan] == ["x.pst", "x-2.pst"]
    made = copies.copy_archives(sources, str(case), told.append)
    assert sorted(os.listdir(case)) == ["x-2.pst", "x.pst"] and (case / "x-2.pst").read_bytes() == b"other"
    assert told[-1].percent == 100 and not any(c.done for c in made)
    assert all(c.done for c in copies.copy_archives(sources, str(case))) and len(os.listdir(case)) == 2
    assert os.path.getmtime(case / "x.pst") == os.path.getmtime(a / "x.pst")
    assert copies.same_archive(sources[0], str(case / "x.pst")) and not copies.same_archive(sources[0], "none")
    # a third of that name and another size goes on counting; the same source twice has one place
    (tmp_path / "x.pst").write_bytes(b"longer text")
    assert copies.free_place(str(case), str(tmp_path / "x.pst")).endswith("x-3.pst")
    assert len({c.target for c in copies.plan_copies([sources[0]] * 2, str(tmp_path / "new"))}) == 1


def test_progress():
    assert str(copies.progress(50, 200, 10)) == "25.0%, 300.0 a minute, 00:00:30 to go"
    assert str(copies.progress(0, 0, 0)) == "0.0%, 0.0 a minute, --:--:-- to go"
    assert copies.progress(5, 5, 1).remaining is None and copies.clock(360_061) == "100:01:01"
