"""The four tasks, end to end: files in storage become points of a collection, again and again."""

import io
import json
import zipfile

from sparkloom.operators.collection import Store
from sparkloom.operators.dense import HashEncoder
from sparkloom.operators.ingest import Ingestor
from sparkloom.operators.jobs import Registry

AT = "2024-01-01T00:00:00Z"


def run(ingestor, task, params):
    seen, registry = [], Registry(ingestor.tasks())
    end = registry.run({"job_id": "j", "task_name": task, "task_params": json.dumps(params | {"at": AT})}, seen.append)
    assert end["status"] == "FINISHED", end
    assert [e["percentage"] for e in seen if e["event"] == "job_progress"][-1] == 95
    return json.loads(end["result"])


def archive(path, **members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_py", ".py").replace("_md", ".md").replace("_docx", ".docx"), body)
    path.write_bytes(out.getvalue())
    return str(path)


def test_tasks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ingestor = Ingestor(spark, store, lambda: HashEncoder(8))
    zip_path = archive(tmp_path / "my_repo.zip", src__a_py="def f():\n    return 1\n", readme_md="# R\n\ntext", bad_docx="x")
    got = run(ingestor, "process_zip", {"path": zip_path, "collection": "codebase"})
    assert got["chunks"] == 2 and len(got["errors"]) == 1 and got["errors"][0].startswith("bad.docx")
    rows = store.table("codebase").orderBy("file_name").collect()
    assert [(r.file_name, r.repo_name, r.zip_filename, len(r.dense)) for r in rows] == [("readme.md", "my_repo", "my_repo.zip", 8), ("src/a.py", "my_repo", "my_repo.zip", 8)]
    # Again, with another member: the repository is replaced.
    archive(tmp_path / "my_repo.zip", src__b_py="x = 1\n")
    run(ingestor, "process_zip", {"path": zip_path, "collection": "codebase"})
    assert [r.file_name for r in store.table("codebase").collect()] == ["src/b.py"]
    (tmp_path / "n.txt").write_text("hello world")
    for _ in range(2):
        run(ingestor, "process_documents_upload", {"path": str(tmp_path / "n.txt"), "group": "g"})
    assert [(r.file_name, r.group, r.document) for r in store.table("general").collect()] == [("n.txt", "g", "hello world")]
    (tmp_path / "c.py").write_text("y = 2\n")
    run(ingestor, "process_code_file_upload", {"path": str(tmp_path / "c.py"), "repo_name": "other"})
    assert sorted(r.repo_name for r in store.table("codebase").collect()) == ["my_repo", "other"]
    spark.createDataFrame([("https://h/a", "<h1>A</h1><p>text</p>"), ("https://h/b", "<p>not asked</p>")], "url string, html string").write.parquet(str(tmp_path / "pages"))
    for _ in range(2):
        assert run(ingestor, "process_website_scrape", {"pages": str(tmp_path / "pages"), "urls": ["h/a"], "group": "w"})["chunks"] == 1
    assert sorted((r.doc_type, r.url or "") for r in store.table("general").collect()) == [("txt", ""), ("website", "https://h/a")]
    bad = Registry(ingestor.tasks()).run({"job_id": "j", "task_name": "process_website_scrape", "task_params": json.dumps({"pages": "x", "urls": ["ftp://h"], "at": AT})}, lambda e: None)
    assert bad["status"] == "FAILED"
    assert len(list((tmp_path / "store" / "general").iterdir())) <= 2  # older versions go
