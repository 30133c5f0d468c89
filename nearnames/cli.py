"""Command line: ``python -m nearnames.cli <command> ...``.

Relations are folders of CSV or Parquet files that Spark reads and writes; without a
command, ``all`` runs.
"""

from __future__ import annotations

import argparse
import shlex
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nearnames.config import Config
from nearnames.functions import chat, phonetics, programs, scorers
from nearnames.operators import noise, proposer, relabel, scoring
from nearnames.operators.pairs import label_counts
from nearnames.plans import pipeline
from nearnames.runtime import materialise, release
from nearnames.sources import io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="nearnames", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command")

    def command(name: str, text: str, *groups: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("--data", default="data", help="folder of inputs")
        c.add_argument("--results", default="results", help="folder of outputs")
        c.add_argument("--source", default="us", help="suffix of the input files: R_<source>.csv, P_<source>.csv, N_<source>.csv")
        if "registry" in groups:
            c.add_argument("--registry", help="another registry file, cleaned as it is read")
        if "labelled" in groups:
            c.add_argument("--labelled", help="labelled pairs (1, -1) in place of proposed ones; implies --soft-labels")
        if "target" in groups:
            c.add_argument("--target", type=int, help="exact number of unlabelled pairs")
            c.add_argument("--seed", type=int, default=Config.seed)
            c.add_argument("--random-share", type=float, default=Config.random_share)
            c.add_argument("--skip-variants", action=argparse.BooleanOptionalAction, default=Config.skip_variants)
        if "soft" in groups:
            c.add_argument("--soft-labels", action=argparse.BooleanOptionalAction, default=None, help="keep rejected pairs as label -1")
            c.add_argument("--rejected", help="rejected pairs; implies --soft-labels")
        if "io" in groups:
            c.add_argument("--input", required=True)
            c.add_argument("--output", required=True)
        if "seeds" in groups:
            c.add_argument("--input", help="seed pairs, in place of P_<source>.csv")
        if "stage" in groups:
            c.add_argument("--input", help="folder of the earlier stages' outputs, in place of --results")
        if "stage" in groups or "seeds" in groups:
            c.add_argument("--output", help="folder to write into, in place of --results")
        if "model" in groups:
            c.add_argument("--model-url", help="chat endpoint that chooses among candidates; without one, and without --model-command, a threshold stands in")
            c.add_argument("--model", default="", help="model that the endpoint is asked for")
            c.add_argument("--key-variable", default="", help="environment variable, on the workers, that holds the endpoint's key")
            c.add_argument("--model-command", help="local model: a program that answers JSON lines, see process_proposer")
        if "sound" in groups:
            c.add_argument("--eng-command", help="English transcriber, a name a line in and out, such as 'espeak-ng -q --ipa -v en-us'")
            c.add_argument("--fil-command", help="Filipino transcriber with --wordlist and --nbest, such as 'phonetisaurus-g2pfst --model=FILE'")
            c.add_argument("--adapt-command", help="loanword adapter that answers JSON lines, see process_adapter")
        if "scorers" in groups:
            c.add_argument("--scorers", help="folder of scorers (*.toml), in place of the usual scores")
        return c

    command("all", "every stage", "registry", "labelled", "target", "soft", "seeds", "model", "sound", "scorers").add_argument("--from-file", action="store_true", help="take positives from P_<source>.csv, propose nothing")
    command("propose", "add similar names to the known pairs", "registry", "seeds", "model")
    command("noise", "sample unlabelled pairs", "registry", "labelled", "target", "soft", "stage")
    command("assemble", "merge the labelled sources", "soft", "stage", "sound")
    command("score", "add score columns", "stage", "sound", "scorers")
    f = command("featurize", "all features of any pairs", "sound", "scorers")
    f.add_argument("--input", required=True)
    f.add_argument("--output", help="by default the input's name with _pho.csv")
    r = command("relabel", "apply reviewed label changes", "io")
    r.add_argument("--changes", required=True)
    r.add_argument("--allow-missing", action="store_true")
    command("lexicon", "score every query with every name", "io", "sound", "scorers")
    c = command("combine", "union of a folder's CSV files, and one file per class", "io")
    c.add_argument("--class-col")
    c.add_argument("--pattern", default="*.csv")
    c.add_argument("--seed", type=int, default=Config.seed)
    c.add_argument("--no-shuffle", dest="shuffle", action="store_false")
    c.add_argument("--deduplicate", action="store_true")
    c.add_argument("--include-d", action="store_true")
    h = command("hard-negatives", "as many hard negatives as positives", "registry", "seeds", "sound", "scorers")
    h.add_argument("--oversample", type=int, default=Config.hardness_oversample)
    h.add_argument("--min-hardness", type=float, default=Config.min_hardness)
    h.add_argument("--max-hardness", type=float, default=Config.max_hardness)
    h.add_argument("--seed", type=int, default=Config.seed)
    return p


def soft_labels(args: argparse.Namespace) -> bool:
    """Named or implied; naming rejected pairs and forbidding their label is an error."""
    if getattr(args, "labelled", None):
        return True
    if getattr(args, "rejected", None):
        if args.soft_labels is False:
            raise ValueError("--rejected needs soft labels, --no-soft-labels forbids them")
        return True
    return bool(getattr(args, "soft_labels", False))


class Run:
    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args = spark, args
        self.cfg = replace(Config(), seed=getattr(args, "seed", Config.seed))

    def data(self, kind: str) -> str:
        return f"{self.args.data}/{kind}_{self.args.source}.csv"

    def seeds(self) -> str:
        return (getattr(self.args, "input", None) if self.args.command in ("all", "propose", "hard-negatives") else None) or self.data("P")

    def result(self, name: str) -> str:
        return f"{getattr(self.args, 'output', None) or self.args.results}/{name}"

    def earlier(self, name: str) -> str:
        """Where an earlier stage has left ``name``: among this run's results if it runs them all."""
        if self.args.command in ("all", "hard-negatives"):
            return self.result(name)
        return f"{getattr(self.args, 'input', None) or self.args.results}/{name}"

    def need(self, name: str, made_by: str) -> str:
        return io.require(self.spark, self.earlier(name), f"nearnames {made_by}")

    def model(self):
        a = self.args
        if getattr(a, "model_url", None):
            return chat.chat_proposer(a.model_url, a.model, a.key_variable)
        return chat.process_proposer(shlex.split(a.model_command)) if getattr(a, "model_command", None) else None

    def adapters(self) -> dict | None:
        """Outside programs that were named, by what they do."""
        named = {k: shlex.split(v) for k in ("eng", "fil", "adapt") if (v := getattr(self.args, f"{k}_command", None))}
        make = {"eng": programs.line_adapter, "fil": programs.nbest_adapter, "adapt": lambda c: phonetics.process_adapter(c, StructType.fromDDL(phonetics.ADAPTATION).fieldNames())}
        return {k: make[k](c) for k, c in named.items()} or None

    def scorers(self) -> list[scorers.Scorer] | None:
        folder = getattr(self.args, "scorers", None)
        return scorers.load(folder) if folder else None

    def registry(self) -> DataFrame:
        if getattr(self.args, "registry", None):
            return io.registry_file(self.spark, self.args.registry)
        return io.registry(self.spark, self.data("R"), self.data("R").replace(".csv", "_clean.csv"))

    def labelled(self) -> tuple[DataFrame, DataFrame | None]:
        """Positives, and rejected pairs where soft labels are on."""
        a = self.args
        if getattr(a, "labelled", None):
            return io.labelled(self.spark, a.labelled)
        run = self.earlier("lasa_run.json")
        known = self.seeds() if getattr(a, "from_file", False) or not io.exists(self.spark, run) else None
        p = io.positives(self.spark, io.require(self.spark, known, "your list of positive pairs") if known else None, run)
        named = getattr(a, "rejected", None)
        return p, io.rejections(self.spark, named or self.data("N"), run, bool(named)) if soft_labels(a) else None

    # ------------------------------------------------------------ commands

    def propose(self) -> None:
        pairs = io.read_pairs(self.spark, io.require(self.spark, self.seeds(), "your list of seed pairs"))
        # A run's number is fixed once it is written.
        seeds = materialise(proposer.seed_pairs(pairs).withColumn("run", F.monotonically_increasing_id() + 1), "seeds")
        io.write_json(proposer.propose(seeds, self.registry(), self.model(), self.cfg), self.result("lasa_run.json"))

    def noise(self) -> None:
        positive, rejected = self.labelled()
        self._noise(positive, rejected)

    def _noise(self, positive: DataFrame, rejected: DataFrame | None) -> None:
        a = self.args
        out = noise.make_noise(positive, self.registry(), self.cfg) if a.target is None else noise.noise_to_target(positive, self.registry(), a.target, rejected, self.cfg, a.random_share, a.skip_variants)
        io.write_csv(out, self.result("U.csv"))
        io.write_text(self.spark, noise.report_text(io.unlabelled(self.spark, self.result("U.csv")), positive), self.result("U_report.txt"))

    def assemble(self) -> None:
        positive, rejected = self.labelled()
        u = io.unlabelled(self.spark, self.need("U.csv", "noise"))
        io.write_csv(pipeline.in_shuffled_order(pipeline.assemble(positive, u, rejected, self.cfg, self.adapters())), self.result("D.csv"))
        label_counts(io.read_csv(self.spark, self.result("D.csv"), own=True)).show()

    def score(self) -> None:
        before = io.read_csv(self.spark, self.need("D.csv", "assemble"), own=True)
        after = pipeline.features(before, self.adapters(), self.scorers())
        io.write_csv(after, self.result("D_pho.csv"))
        print("new columns:", ", ".join(io.new_columns(before, after)))

    def all(self) -> None:
        if not self.args.from_file and not self.args.labelled:
            self.propose()
        self.noise()
        self.assemble()
        self.score()

    def featurize(self) -> None:
        a = self.args
        out = a.output or a.input.removesuffix(".csv") + "_pho.csv"
        if a.input == out:
            raise ValueError("input and output are the same")
        rows = io.read_pairs(self.spark, io.require(self.spark, a.input, "your table of pairs"), pos="input_place")
        staged = scoring.transcribe(rows.select(*[c for c in ("x_1", "x_2", "label") if c in rows.columns], "input_place"), adapters=self.adapters())
        staged = materialise(staged, "featurize")
        # Rows keep the input's order.
        io.write_csv(staged.orderBy("input_place").drop("input_place"), out.removesuffix(".csv") + "_t.csv")
        done = scoring.all_features(staged, adapters=self.adapters(), own=self.scorers())
        io.write_csv(done.orderBy("input_place").drop("input_place"), out)

    def relabel(self) -> None:
        a = self.args
        base = io.read_pairs(self.spark, a.input, missing=False, need=("x_1", "x_2", "label")).withColumn("pos", F.monotonically_increasing_id())
        changes = io.read_pairs(self.spark, a.changes, missing=False, need=("action", "x_1", "x_2", "new_label")).withColumn("seq", F.monotonically_increasing_id())
        final, log = relabel.relabel(base, changes, allow_missing=a.allow_missing)
        io.write_csv(final.orderBy("turn", "place").select("x_1", "x_2", "label"), a.output)
        io.write_csv(log.orderBy("seq").drop("seq"), a.output.removesuffix(".csv") + "_changes.csv")
        relabel.outcome_counts(log).orderBy("action", "outcome").show(truncate=False)

    def lexicon(self) -> None:
        need = ("x_1", "x_2", "label", "t_eng_1", "t_eng_2", "t_fil_1", "t_fil_2")
        rows = io.read_pairs(self.spark, self.args.input, missing=False, need=need).withColumn("pos", F.monotonically_increasing_id())
        names = rows.select(F.explode(F.array("x_1", "x_2")).alias("name")).distinct()
        asked = rows.where("label = '1'").select(F.explode(F.array("x_1", "x_2")).alias("name")).distinct()
        io.write_parquet(scoring.lexicon_scores(asked, names, scoring.latest_transcripts(rows), adapters=self.adapters(), own=self.scorers()), self.args.output)

    def combine(self) -> None:
        a = self.args
        for k, path in io.combine_csv(self.spark, a.input, a.output, a.class_col, a.pattern, a.seed, a.shuffle, a.deduplicate, a.include_d).items():
            print(k, path)

    def hard_negatives(self) -> None:
        a = self.args
        if a.min_hardness >= a.max_hardness:
            raise ValueError("--min-hardness must be below --max-hardness")
        positive = io.read_pairs(self.spark, io.require(self.spark, self.seeds(), "your list of positive pairs")).select("x_1", "x_2").dropna()
        mined = noise.make_noise(positive, self.registry(), replace(self.cfg, positive_prevalence=1 / (1 + a.oversample)))
        hard = pipeline.hard_negatives(positive, mined, a.min_hardness, a.max_hardness)
        d = pipeline.assemble(positive, hard.select("x_1", "x_2"), None, self.cfg, self.adapters())
        io.write_csv(pipeline.in_shuffled_order(d), self.result("D.csv"))
        io.write_csv(pipeline.features(io.read_csv(self.spark, self.result("D.csv"), own=True), self.adapters(), self.scorers()), self.result("D_pho.csv"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    args = parser().parse_args(argv or ["all"])
    if args.command is None:
        args = parser().parse_args(["all", *argv])
    own, spark = spark is None, spark or SparkSession.builder.appName("nearnames").getOrCreate()
    try:
        getattr(Run(spark, args), args.command.replace("-", "_"))()
        if own:
            release(spark)
    except (FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
