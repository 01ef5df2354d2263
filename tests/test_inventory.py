"""The whole run, its resumption, settings and logging."""

import json
import logging

import pytest
from compare import DATA

from hostloom.plans import observe
from hostloom.plans.config import Config, flattened, from_environment, merged
from hostloom.plans.inventory import STAGES, Inventory, sql
from hostloom.sources.inventory import host_raw


def test_run_and_resume(spark, tmp_path):
    raw = host_raw(spark, DATA).filter("row_id < 40")
    first = Inventory(spark, raw, str(tmp_path), "2024-01-31 00:00:00", Config({"output": {"formats": ["json", "csv"]}}))
    out = first.run()
    assert list(out) == STAGES and not first.resumed
    first.export(out)
    assert out["entities"].count() == out["components"].count() == out["hosts"].count() > 0
    assert "entities:" in first.summary(out)
    again = Inventory(spark, raw, str(tmp_path), "2024-01-31 00:00:00")
    assert again.run()["entities"].count() == out["entities"].count() and again.resumed == STAGES
    assert sql(spark, {"entities": out["entities"]}, "SELECT count(*) AS n FROM entities").first().n == out["entities"].count()


def test_run_over_a_folder_of_unlike_tables(spark, tmp_path):
    rows = {
        "vm": ("instance_name string, private_ip string, env string, owner string", [(f"web-{k}", f"10.0.0.{k}", "prod", "team-a") for k in range(1, 6)]),
        "dns": ("fqdn string, ip_address string, application string", [(f"web-{k}.corp.example.com", f"10.0.0.{k}", "web") for k in range(1, 4)] + [("db-1.corp.example.com", None, "database")]),
        "notes": ("id int, text string", [(1, "no host here")]),
    }
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/in/{name}.parquet")
    out = Inventory.of_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out", "2024-01-31 00:00:00").run()
    got = {r.hostname: (r.ip_address, r.environment, r.owner) for r in out["hosts"].collect()}
    assert len(got) == 9 and got["web-2"] == ("10.0.0.2", "prod", "team-a") and got["db-1.corp.example.com"][0] is None
    assert out["entities"].count() == 9 and out["relationships"].count() > 0


def test_settings(tmp_path):
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"scan": {"sample_percent": 5}}))
    c = Config.load(str(path), {"HOSTLOOM_SCAN__MAX_ROWS_PER_TABLE": "7", "OTHER": "1"})
    assert (c.get("scan.sample_percent"), c.get("scan.max_rows_per_table"), c.get("no.such", 4)) == (5, 7, 4)
    assert from_environment(flattened(c.values)) == c.values
    c.set("scan.sample_percent", 50)
    c.save(str(path))
    assert Config.load(str(path), {}).get("scan.sample_percent") == 50 and (tmp_path / "c.json.bak").exists()
    with pytest.raises(ValueError):
        Config.load(None, {"HOSTLOOM_SCAN__SAMPLE_PERCENT": "0"})
    assert Config(profile="development").get("scan.max_rows_per_table") == 1000
    assert "HOSTLOOM_SCAN__SAMPLE_PERCENT=50" in c.export("env") and c.summary()["rules"] > 40


def test_logging(tmp_path):
    log = observe.set_up("INFO", "json", str(tmp_path / "log"))
    observe.audit(log, "store", rows=3)
    with observe.level(log, "ERROR"):
        log.warning("unheard")
    log.handlers[0].flush()
    lines = [json.loads(x) for x in (tmp_path / "log").read_text().splitlines()]
    assert len(lines) == 1 and (lines[0]["action"], lines[0]["rows"]) == ("store", 3)
    t = observe.Timings()
    assert t.timed(lambda x: x + 1)(1) == 2 and next(iter(t.statistics().values()))["count"] == 1
    logging.getLogger("hostloom").handlers.clear()
