"""Commands: ``prepare`` a corpus, ``run`` a model over it, ``compare`` stored runs.  ``python -m tesserine COMMAND -h``."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import sentences as S
from tesserine.operators import retrieval as R
from tesserine.operators import vocabulary as VO
from tesserine.plans import export as X
from tesserine.plans import mocks, report, runner
from tesserine.session import ship
from tesserine.sources import corpus as C
from tesserine.sources import runs as RU

PROMPT_VERSION = "v3"


def named(path: str) -> Callable:
    """What ``module:name`` names: a maker of clients, or an encoder."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    docs = C.read_raw(spark, args.bruto, args.prefixo)
    print(f"{C.write_corpus(docs.withColumn('ano', F.lit(None).cast('int')), args.saida)} documents in {args.saida}")
    for row in C.warnings(docs).where(F.size("warnings") > 0).orderBy("id").toLocalIterator():
        print(f"  {row['id']}: {'; '.join(row['warnings'])}")


def digest(rows: DataFrame) -> str:
    """One digest of all rows in whatever order: of their number and of sums of the parts of their own hashes."""
    each = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", at, 8), 16, 10).cast("decimal(20,0)")) for at in range(1, 65, 8)]
    return each.agg(F.sha2(F.concat_ws(",", F.count(F.lit(1)), *parts), 256)).first()[0]


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    whole = mocks.corpus(spark) if args.mock else C.read_corpus(spark, args.corpus)
    base = mocks.base(spark) if args.mock else C.read_base(spark, args.base)
    docs = whole.where(F.col("id").isin(*args.ids.split(","))) if args.ids else whole
    make = mocks.client if args.mock else named(args.cliente)
    encoder = named(args.codificador) if args.codificador else None
    # the numbered sentences are read by every technique
    sentences = S.numbered(docs, "id", "resumo")
    models = [mocks.MODEL] if args.mock else args.modelo.split(",")
    folders = []
    for row in runner.grid(spark, models, R.TECHNIQUES if args.todos else [args.tecnica], args.versao).collect():
        folder = f"{args.saida}/{row['execucao']}" + (f"__{args.sufixo}" if args.sufixo else "")
        began = datetime.now().isoformat(timespec="seconds")
        answers = runner.execute(docs, sentences, base, row["modelo"], row["tecnica"], args.versao, make, f"{folder}/parquet", encoder, fresh=args.sobrescrever)
        facts = runner.provenance(
            spark, row["modelo"], row["tecnica"], args.versao, sha256_do_corpus=digest(whole), sha256_da_base=digest(base),
            top_k_frases=str(R.TOP_SENTENCES), top_k_verbetes=str(R.TOP_ENTRIES), inicio=began, fim=datetime.now().isoformat(timespec="seconds"),
        )
        X.write_run(whole, answers, facts, folder)
        first, second = X.sheets(docs, answers, sentences)
        X.write_sheets({"respostas": first, "detalhes": second, "execucao": X.run_sheet(facts, answers)}, f"{folder}/planilha")
        folders.append(folder)
        print(folder)
    return folders


def compare(spark: SparkSession, args: argparse.Namespace) -> None:
    base = mocks.base(spark) if args.mock else C.read_base(spark, args.base)
    reference = None
    known = VO.vocabulary(VO.entry_forms(base))
    if args.referencia:
        known, *reference = RU.read_reference(spark, args.referencia, base)
    encoder = None if args.sem_embedding else (named(args.codificador) if args.codificador else R.hashed_encoder())
    answers, runs = RU.read_answers(spark, args.sugestoes), RU.read_runs(spark, args.sugestoes)
    found = report.evaluate(answers, runs, RU.described(answers, runs), known, reference and tuple(reference), encoder)
    written = report.write_evaluation(found, args.saida)
    for name in ("execucoes", "diferencas_pareadas"):
        if name in written:
            # a row a run, or a pair of runs
            print(X.markdown([r.asDict() for r in written[name].orderBy(written[name].columns[0]).toLocalIterator()]))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tesserine", description=__doc__)
    commands = top.add_subparsers(required=True)
    one = commands.add_parser("prepare", help="clean a raw file into a corpus")
    one.add_argument("--bruto", required=True)
    one.add_argument("--saida", required=True)
    one.add_argument("--prefixo", default="D")
    one.set_defaults(command=prepare)
    one = commands.add_parser("run", help="ask a model about each document; goes on where it stopped")
    one.add_argument("--corpus")
    one.add_argument("--base")
    one.add_argument("--saida", required=True)
    one.add_argument("--cliente", help="module:function that makes a client")
    one.add_argument("--codificador", help="module:function, an encoder of texts")
    one.add_argument("--modelo", help="one, or several with commas")
    one.add_argument("--tecnica", default="hibrido", choices=R.TECHNIQUES)
    one.add_argument("--todos", action="store_true", help="every model with every technique")
    one.add_argument("--versao", default=PROMPT_VERSION)
    one.add_argument("--ids", help="these documents alone, with commas")
    one.add_argument("--sufixo", help="added to the folder's name")
    one.add_argument("--mock", action="store_true", help="invented documents and answers")
    one.add_argument("--sobrescrever", action="store_true", help="from the start")
    one.set_defaults(command=run)
    one = commands.add_parser("compare", help="evaluate all runs below a folder")
    one.add_argument("--sugestoes", required=True)
    one.add_argument("--base")
    one.add_argument("--referencia")
    one.add_argument("--saida", required=True)
    one.add_argument("--codificador")
    one.add_argument("--sem-embedding", action="store_true", help="leaves the themes out")
    one.add_argument("--mock", action="store_true", help="the base of the invented documents")
    one.set_defaults(command=compare)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    top = parser()
    args = top.parse_args(argv)
    needed = {run: ("corpus", "base", "cliente", "modelo"), compare: ("base",)}.get(args.command, ())
    if lacking := [n for n in needed if not args.mock and not getattr(args, n)]:
        top.error(f"without --mock these are needed: {', '.join('--' + n for n in lacking)}")
    spark = spark or SparkSession.builder.appName("tesserine").getOrCreate()
    ship(spark)
    return args.command(spark, args)


if __name__ == "__main__":
    main()
