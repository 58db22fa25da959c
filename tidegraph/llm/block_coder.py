"""The range coder of token blocks as Spark functions.

The coder is a loop over single ids with a model that learns from each, so it is written in Java
(BlockCoder.java). Spark's own compiler for generated code (Janino) compiles the source on the
driver; the classes go into a jar in the shared scratch folder, which executors load, also those
that start later.
"""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidegraph.llm.common import scratch_dir
from tidegraph.llm.files import write_bytes

SOURCES = ("BlockCoder", "EncodeBlock", "DecodeBlock")
FUNCTIONS = {"tidegraph_encode_block": "tidegraph.llm.EncodeBlock", "tidegraph_decode_block": "tidegraph.llm.DecodeBlock"}


def _jar(spark: SparkSession) -> bytes:
    """The compiled classes."""
    jvm = spark.sparkContext._jvm
    parent = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    sources = [Path(__file__).with_name(f"{name}.java").read_text().partition(";")[2] for name in SOURCES]
    imports = sorted({line for text in sources for line in text.splitlines() if line.startswith("import ")})
    bodies = ["\n".join(line for line in text.splitlines() if not line.startswith("import ")) for text in sources]
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(parent)
    compiler.cook("\n".join(["package tidegraph.llm;", *imports, *bodies]))
    classes = compiler.getBytecodes()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as jar:
        for name in classes:
            jar.writestr(name.replace(".", "/") + ".class", bytes(classes[name]))
    return out.getvalue()


def register(spark: SparkSession) -> None:
    """Make the functions known to a session, once."""
    if all(spark.catalog.functionExists(name) for name in FUNCTIONS):
        return
    path = f"{scratch_dir(spark)}/block-coder.jar"
    write_bytes(path, _jar(spark))
    spark.sql(f"ADD JAR '{path}'")
    kind = spark._jsparkSession.parseDataType(BinaryType().json())
    for name, cls in FUNCTIONS.items():
        made = spark.sparkContext._jvm.org.apache.spark.util.Utils.classForName(cls, True, False)
        spark._jsparkSession.udf().register(name, made.newInstance(), kind)


def encode_block(spark: SparkSession, ids: Column) -> Column:
    """The coded block of ids (binary: unsigned numbers of four bytes, the lowest first)."""
    register(spark)
    return F.call_function("tidegraph_encode_block", ids)


def decode_block(spark: SparkSession, block: Column) -> Column:
    """The ids of a coded block, as encode_block takes them; null where the block is damaged."""
    register(spark)
    return F.call_function("tidegraph_decode_block", block)
