import json
import stat

import pytest

from lorekiln.sources import settings


def test_a_missing_file_has_the_defaults(tmp_path):
    found = settings.read(tmp_path / "none.json")
    assert found["chunk_max_tokens"] == 800 and found["auto_inject"] is True and found["notes_dir"] is None
    found["readers"]["x"] = 1
    assert settings.read(tmp_path / "none.json")["readers"] == {}


def test_written_settings_come_back(tmp_path):
    path = tmp_path / "a" / "b" / "settings.json"
    given = settings.checked({"store_dir": "/data/é", "notes_dir": "/notes", "last_ingest": {"x": 1.5}})
    settings.write({"auto_sync": True}, path)
    settings.write(given, path)
    assert settings.read(path) == given
    assert stat.S_IMODE(path.stat().st_mode) == 0o600
    assert [p.name for p in path.parent.iterdir()] == ["settings.json"]


@pytest.mark.parametrize(
    "key, value",
    [("store_dir", 3), ("store_dir", "/a/../b"), ("index_dir", ".."), ("notes_dir", "x/.."), ("notes_dir", []), ("auto_sync", 1), ("chunk_max_tokens", "9"), ("chunk_max_tokens", True), ("readers", None)],
)
def test_unsound_values_give_way(key, value):
    assert settings.checked({key: value, "other": 1}) == settings.checked({})


def test_a_folder_may_have_dots_in_a_name():
    assert settings.checked({"store_dir": "/a..b/c"})["store_dir"] == "/a..b/c"


def test_what_cannot_be_written_leaves_the_old_file(tmp_path):
    path = tmp_path / "settings.json"
    settings.write({"auto_sync": True}, path)
    with pytest.raises(TypeError):
        settings.write({"auto_sync": object()}, path)
    assert json.loads(path.read_text()) == {"auto_sync": True}
    assert len(list(tmp_path.iterdir())) == 1


def test_a_file_without_an_object_is_an_error(tmp_path):
    path = tmp_path / "settings.json"
    path.write_text("[1]")
    with pytest.raises(ValueError):
        settings.read(path)
