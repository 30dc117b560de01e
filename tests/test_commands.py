import pytest

from sightline.__main__ import main

PLUGS = ["--decoder", "standins:Decoder", "--detector", "standins:Detector"]
PEOPLE = [*PLUGS, "--embedder", "standins:Embedder"]


@pytest.fixture
def clip(tmp_path):
    (tmp_path / "a.mp4").write_text("2 10")
    (tmp_path / "audio.mov").write_text("audio")
    return str(tmp_path / "a.mp4")


def test_commands(spark, clip, tmp_path, capsys):
    def said(*argv):
        assert main(list(argv), spark) == 0
        return capsys.readouterr().out

    assert "'frames': 10" in said("info", clip, *PLUGS[:2])
    assert "Extracted 5 frames." in said("extract", clip, *PLUGS[:2])
    out = said("detect", clip, *PLUGS, "--output-dir", str(tmp_path / "d"))
    assert "Total faces detected: 10" in out and "frames/sec" in out and len(list((tmp_path / "d").rglob("*.png"))) == 5
    out = said("gallery", clip, *PLUGS, "--output-dir", str(tmp_path / "g"), "--select-index", "1", "--max-items", "3")
    assert "Gallery candidates: 10" in out and "Gallery items: 3" in out and "Selected gallery item #2" in out and (tmp_path / "g" / "face-gallery.png").exists()
    out = said("group", clip, *PEOPLE, "--output-dir", str(tmp_path / "p"), "--select-index", "0")
    assert "Identity groups found: 2" in out and "Face tracks built: 2" in out and "Selected person #1" in out and (tmp_path / "p" / "identity-gallery.png").exists()
    out = said("timestamps", clip, *PEOPLE, "--select-index", "1")
    assert "Person #2: 5 detections" in out and "Appearance 1: 00:00.00 (0.00s) to 00:04.50 (4.50s)" in out


def test_what_cannot_be_done(spark, clip, tmp_path, capsys):
    for argv, words in (
        (["info", str(tmp_path / "none.mp4"), *PLUGS[:2]], "exists"),
        (["info", str(tmp_path / "audio.mov"), *PLUGS[:2]], "video stream"),
        (["extract", clip, *PLUGS[:2], "--interval", "0"], "interval"),
        (["gallery", clip, *PLUGS, "--output-dir", str(tmp_path), "--select-index", "99"], "range"),
        (["timestamps", clip, *PEOPLE, "--select-index", "7"], "range"),
    ):
        assert main(argv, spark) == 1
        assert words in capsys.readouterr().err
    with pytest.raises(SystemExit):
        main(["nothing"], spark)
