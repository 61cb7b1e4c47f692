"""The command-line jobs, import and export."""

import json

import pytest

from wrenfold.__main__ import main
from wrenfold.operators.store import KnowledgeStore
from wrenfold.sources.records import read_json


def test_jobs(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/kb"
    saves = [{"seq": i, "title": t, "kind": "workflow", "context": "c", "content": f"how to {t}", "verification": "v", "tags": ["x"], "project_scope": s} for i, (t, s) in enumerate([("brew tea", "a"), ("fix a bicycle", None)])]
    (tmp_path / "saves.jsonl").write_text("".join(json.dumps(s) + "\n" for s in saves))
    main(["--root", root, "save", str(tmp_path / "saves.jsonl")])
    main(["--root", root, "search", "bicycle", "--compact"])
    assert "**fix a bicycle**" in capsys.readouterr().out
    main(["--root", root, "--lexical-only", "search", "bicycle"])
    out = capsys.readouterr().out
    assert "(ranking: lexical_only)" in out and "- **Match Signals:** BM25 #1" in out
    main(["--root", root, "stats"])
    out = capsys.readouterr().out
    assert "Total entries:      2" in out and "  - global               : 1 entries" in out
    main(["--root", root, "recent"])
    assert capsys.readouterr().out.count("- **") == 2

    entry = KnowledgeStore(spark, root).current().where("title = 'brew tea'").first()["id"]
    main(["--root", root, "get", entry])
    assert json.loads(capsys.readouterr().out)["title"] == "brew tea"
    main(["--root", root, "history", entry])
    assert "version" in capsys.readouterr().out

    main(["--root", root, "export", "-o", str(tmp_path / "out.jsonl"), "--jsonl"])
    assert "Exported 2" in capsys.readouterr().out
    other = KnowledgeStore(spark, f"file://{tmp_path}/other")
    rows = read_json(spark, str(tmp_path / "out.jsonl"))
    with pytest.raises(ValueError):
        other.import_records(rows)
    assert other.import_records(rows, by_key=True) == 2
    assert {r["title"] for r in other.current().collect()} == {"brew tea", "fix a bicycle"}
    # again: the keys match, so both are overwritten, and their history says merge
    main(["--root", f"file://{tmp_path}/other", "import", "-i", str(tmp_path / "out.jsonl"), "-m"])
    assert other.current().count() == 2
    assert [r["operation"] for r in other.history(other.current().first()["id"]).collect()] == ["merge"]
    assert KnowledgeStore(spark, root).import_records(rows) == 2 and other.size_bytes() > 0
    main(["--root", root, "rollback", entry, "1"])
    main(["--root", root, "delete", entry, "nobody"])
    assert "Restored version 1" in (out := capsys.readouterr().out) and "Deleted 1 " in out
