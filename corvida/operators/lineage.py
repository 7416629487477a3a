"""Plans, checkpoints and the evaluation lock as write-once JSON, and what is left to run.

Lineage is a few small documents per experiment, so the driver writes them;
joins with data go through DataFrames.
"""

from __future__ import annotations

import hashlib
import json
import os
import platform
import uuid
from contextlib import contextmanager
from datetime import UTC, datetime
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.operators.contracts import check_apart, check_relative_path
from corvida.sources.store import create_once, read_bytes

PHASES = ("fit", "test")


def canonical(value) -> bytes:
    """JSON with sorted keys and no spaces; NaN is refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def digest(value) -> str:
    return hashlib.sha256(value if isinstance(value, bytes) else canonical(value)).hexdigest()


def write_once(path: str, value) -> str:
    """Write a JSON document to a new file, whole or not at all, on any store; its digest. An equal document may be there already."""
    data = canonical(value)
    try:
        create_once(path, data)
    except FileExistsError:
        if read_bytes(path) != data:
            raise ValueError(f"{path} holds another document") from None
    return digest(data)


def plan_faults(seeds: list[int], **sizes: int) -> list[str]:
    """What is wrong with a plan, in words: a paired comparison needs distinct runs that NumPy's seeding takes, and sizes at or above their least."""
    least = {"epochs": 1, "batch_size": 1, "repetitions": 2}
    odd = [s for s in seeds if isinstance(s, bool) or not isinstance(s, int) or s < 0 or s.bit_length() > 32]
    faults = [f"{name} is {value}, under {least[name]}" for name, value in sizes.items() if value < least[name]]
    faults += [f"{s!r} is no unsigned 32-bit seed" for s in odd]
    if len({*map(repr, seeds)}) < max(2, len(seeds)):
        faults.append("two or more seeds are needed, each once")
    return faults


def check_plan(seeds: list[int], epochs: int, batch_size: int, repetitions: int) -> None:
    """Raise ValueError with all faults of a plan at once."""
    if faults := plan_faults(seeds, epochs=epochs, batch_size=batch_size, repetitions=repetitions):
        raise ValueError("; ".join(faults))


class Experiment:
    """A folder with a frozen plan, a checkpoint for each phase and seed, and a lock between the phases."""

    def __init__(self, folder: str, spark: SparkSession | None = None):
        self.folder, self.spark = folder, spark

    def _read(self, name: str):
        path = os.path.join(self.folder, name)
        if not os.path.exists(path):
            return None
        with open(path, "rb") as f:
            return json.load(f)

    def prepare(self, seeds: list[int], epochs: int, batch_size: int, repetitions: int, inputs: dict[str, str], data: str | None = None) -> dict:
        """Freeze the plan; ``inputs`` maps names to digests of what the runs read, and ``data`` is the folder they lie in, which must be apart."""
        check_plan(seeds, epochs, batch_size, repetitions)
        if data is not None:
            check_apart(data, self.folder)
        os.makedirs(self.folder)
        plan = {"schema_version": 1, "seeds": seeds, "epochs": epochs, "batch_size": batch_size, "repetitions": repetitions, "inputs": inputs, "python": platform.python_version(), "created_at": datetime.now(UTC).isoformat()}
        write_once(os.path.join(self.folder, "plan.json"), plan)
        return plan

    def plan(self, inputs: dict[str, str] | None = None) -> dict:
        """The plan, after comparing the digests of its inputs."""
        plan = self._read("plan.json")
        if plan is None:
            raise ValueError("no plan")
        if inputs is not None and plan["inputs"] != inputs:
            raise ValueError("inputs have changed since the plan was made")
        return plan

    def done(self, phase: str, seed: int):
        entry = self._read(f"{phase}-{seed}.json")
        if entry is not None:
            if (entry["phase"], entry["seed"], entry["plan"]) != (phase, seed, digest(self.plan())):
                raise ValueError(f"checkpoint {phase} {seed} belongs to another plan")
            if faults := self.file_faults(entry):
                raise ValueError(f"files of {phase} {seed}: {faults}")
        return entry

    def job_folder(self, phase: str, seed: int) -> str:
        """Where a run leaves its files, made at the first call."""
        path = os.path.join(self.folder, "files", f"{phase}-{seed}")
        os.makedirs(path, exist_ok=True)
        return path

    def _files(self, phase: str, seed: int) -> dict[str, str]:
        root, out = self.job_folder(phase, seed), {}
        for at, _, names in os.walk(root):
            for name in names:
                path = os.path.join(at, name)
                key = check_relative_path(os.path.relpath(path, root).replace(os.sep, "/"))
                if os.path.islink(path):
                    raise ValueError(f"{key} is a link")
                with open(path, "rb") as f:
                    out[key] = hashlib.file_digest(f, "sha256").hexdigest()
        return out

    def file_faults(self, entry: dict) -> list[str]:
        """Files of a finished run that are missing, came later or have changed since."""
        stated, found = entry.get("files", {}), self._files(entry["phase"], entry["seed"])
        return [f"{name} {'missing' if name not in found else 'extra' if name not in stated else 'changed'}" for name in sorted(stated.keys() | found.keys()) if stated.get(name) != found.get(name)]

    def record(self, phase: str, seed: int, details: dict) -> dict:
        """Store a finished run. No fit after the lock, no test before it."""
        plan = self.plan()
        if phase not in PHASES or seed not in plan["seeds"]:
            raise ValueError("unknown phase or seed")
        locked = self._read("lock.json")
        if phase == "fit" and locked:
            raise ValueError("fits are sealed")
        if phase == "test" and not locked:
            raise ValueError("seal all fits before a test")
        entry = {"phase": phase, "seed": seed, "plan": digest(plan), "details": details, "files": self._files(phase, seed)}
        write_once(os.path.join(self.folder, f"{phase}-{seed}.json"), entry)
        return entry

    def lock(self) -> dict:
        """Seal all fits by their digests; repeatable."""
        plan = self.plan()
        fits = {str(s): self.done("fit", s) for s in plan["seeds"]}
        if missing := [s for s, e in fits.items() if e is None]:
            raise ValueError(f"fits are missing: {missing}")
        lock = {"plan": digest(plan), "fits": {s: digest(e) for s, e in fits.items()}}
        write_once(os.path.join(self.folder, "lock.json"), lock)
        return lock

    def attempt(self, phase: str, seed: int, job) -> dict:
        """Run one job, keep a log of how it ended whether it fails or not, and store its result."""
        began, clock = datetime.now(UTC).isoformat(), perf_counter()
        log = {"phase": phase, "seed": seed, "started_at": began, "python": platform.python_version()}
        path = os.path.join(self.folder, "attempts")
        os.makedirs(path, exist_ok=True)
        try:
            with job_settings(self.spark) as log["settings"]:
                details = job()
            log["status"] = "finished"
        except BaseException as e:
            log |= {"status": "failed", "error": type(e).__name__}
            raise
        finally:
            log["seconds"] = round(perf_counter() - clock, 3)
            write_once(os.path.join(path, f"{phase}-{seed}-{uuid.uuid4().hex}.json"), log)
        return self.record(phase, seed, details)

    def attempts(self) -> list[dict]:
        """All attempts in the order of their start."""
        path = os.path.join(self.folder, "attempts")
        logs = [self._read(os.path.join("attempts", n)) for n in (os.listdir(path) if os.path.isdir(path) else [])]
        return sorted(logs, key=lambda x: (x["started_at"], x["phase"], x["seed"]))

    def _sealed(self) -> dict[int, dict]:
        """The fits, each as the lock has it."""
        lock, fits = self._read("lock.json"), {}
        if lock is None:
            raise ValueError("no lock: fits aren't sealed")
        for seed in self.plan()["seeds"]:
            fits[seed] = self.done("fit", seed)
            if fits[seed] is None or lock["fits"][str(seed)] != digest(fits[seed]):
                raise ValueError(f"the fit of seed {seed} changed after the lock")
        return fits

    def run(self, fit, test) -> list[dict]:
        """Do what is left: ``fit(seed)`` for all seeds, the lock, then ``test(seed, fit details)``."""
        seeds = self.plan()["seeds"]
        for seed in seeds:
            if self.done("fit", seed) is None:
                self.attempt("fit", seed, lambda s=seed: fit(s))
        self.lock()
        for seed, entry in self._sealed().items():
            if self.done("test", seed) is None:
                self.attempt("test", seed, lambda s=seed, e=entry: test(s, e["details"]))
        return [self.done("test", s) for s in seeds]

    def summarize(self, measure) -> dict:
        """``results.json``: what ``measure`` makes of ``(seed, fit, test)`` records, with the digests it rests on.

        A second call must give the same results, or ValueError.
        """
        fits = self._sealed()
        tests = {s: self.done("test", s) for s in fits}
        if missing := [s for s, e in tests.items() if e is None]:
            raise ValueError(f"tests are missing: {missing}")
        rests_on = {"plan": digest(self.plan()), "lock": digest(self._read("lock.json")), "tests": {str(s): digest(e) for s, e in tests.items()}}
        out = {"results": measure([(s, fits[s], tests[s]) for s in sorted(fits)]), "experiment": rests_on}
        write_once(os.path.join(self.folder, "results.json"), out)
        return out


@contextmanager
def job_settings(spark: SparkSession | None):
    """Settings under which a job's plan depends on its data alone, put back afterwards; their values."""
    wanted = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.session.timeZone": "UTC"} if spark else {}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield wanted
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def source_digests(root: str) -> dict[str, str]:
    """SHA-256 of each module below a folder, by its relative path; part of a plan's inputs."""
    out = {}
    for at, _, names in os.walk(root):
        for name in sorted(n for n in names if n.endswith(".py")):
            with open(os.path.join(at, name), "rb") as f:
                out[os.path.relpath(os.path.join(at, name), root).replace(os.sep, "/")] = hashlib.file_digest(f, "sha256").hexdigest()
    return out


def pending(plan: DataFrame, finished: DataFrame) -> DataFrame:
    """``phase, seed`` pairs of the plan without a finished run."""
    wanted = plan.select("seed").distinct().select(F.explode(F.array(*map(F.lit, PHASES))).alias("phase"), "seed")
    return wanted.join(finished.select("phase", "seed"), ["phase", "seed"], "left_anti")


def bound_thresholds(models: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each model's threshold by the digest of its content, whatever the order of either table."""
    return models.join(decisions, "model_sha256")


def versions(spark: SparkSession) -> dict[str, str]:
    """What the results depend on besides the inputs."""
    return {"python": platform.python_version(), "spark": spark.version}
