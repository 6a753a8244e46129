"""The codec's kernel in the JVM (``jvm/Codec.java``): coding of rows without a Python
worker. The driver compiles its source by the compiler that Spark itself uses and ships
the classes to the executors as a jar. It writes the same bytes as ``codec``, which
still does the settings that it doesn't cover, and all of them on a session without a
JVM at hand."""

from __future__ import annotations

import atexit
import os
import pkgutil
import shutil
import sys
import tempfile
import zipfile
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillbit.config import BYTE_VOCABULARY, FLAG_ADAPTIVE, FLAG_LZP, FLAG_NGRAM, FLAG_SKIP, SKIP_LZP, SKIP_NGRAM, Config

ENCODE, DECODE, REGIONS, PARTS = "quillbit_encode", "quillbit_decode", "quillbit_regions", "quillbit_parts"
CODED = "struct<tokens: bigint, bits: bigint, stream: binary, skipped: bigint, bias: array<double>>"
SEGMENTS = "array<struct<seg_no: int, kind: string, off: bigint, len: bigint>>"
CUT = "array<struct<seg_no: int, part: int, data: binary>>"
#: Settings in the order of the kernel, after the four flags and around the temperature.
_WHOLE = ("ngram_order", "lzp_order", "lzp_least", "warmup", "inner_cap", "ngram_cap", "lzp_cap", "total")
_REAL = ("mixer_rate", "adaptive_rate", "skip_bits")
_BOUNDS = {"vocabulary": (BYTE_VOCABULARY, BYTE_VOCABULARY), "ngram_order": (1, 8), "lzp_least": (1, 8), "lzp_order": (1, 8), "warmup": (0, 1 << 30), "total": (BYTE_VOCABULARY + 1, 1 << 30)} | dict.fromkeys(("inner_cap", "ngram_cap", "lzp_cap"), (1, 1 << 30))
_JARS: dict[str, str] = {}


def _jar(jvm) -> str:
    """The jar of this process, made once and removed at its end."""
    if "path" not in _JARS:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.Thread.currentThread().getContextClassLoader())
        compiler.cook(pkgutil.get_data("quillbit", "jvm/Codec.java").decode())
        folder = tempfile.mkdtemp(prefix="quillbit-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(path := os.path.join(folder, "quillbit-codec.jar"), "w") as out:
            for name, code in dict(compiler.getBytecodes()).items():
                out.writestr(name.replace(".", "/") + ".class", bytes(code))
        _JARS["path"] = path
    return _JARS["path"]


def registered(spark: SparkSession) -> bool:
    """Whether the session has the kernel's functions; they are added where it can."""
    if all(spark.catalog.functionExists(n) for n in (ENCODE, DECODE, REGIONS, PARTS)):
        return True
    try:
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        spark.sql(f"ADD JAR '{_jar(jvm)}'").collect()
        loader = spark._jsparkSession.sharedState().jarClassLoader()
        for name, of, kind in ((ENCODE, "Encode", CODED), (DECODE, "Decode", "binary"), (REGIONS, "Segments", SEGMENTS), (PARTS, "Parts", CUT)):
            made = loader.loadClass(f"quillbit.Codec${of}").getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0))
            spark._jsparkSession.udf().register(name, made.newInstance(gateway.new_array(jvm.java.lang.Object, 0)), jvm.org.apache.spark.sql.types.DataType.fromDDL(kind))
        return True
    except Exception as reason:  # noqa: BLE001
        print(f"the codec runs in Python: {reason}", file=sys.stderr)
        return False


def covers(config: Config) -> bool:
    return all(a <= getattr(config, n) <= b for n, (a, b) in _BOUNDS.items()) and config.lzp_least <= config.lzp_order


def settings_of(config: Config, own: bool) -> tuple[Column, Column]:
    """The kernel's settings as text, and whether it covers them; with ``own`` those of
    the columns (flags, temperature, settings) go before the config's."""
    plain = Config()
    if not own:
        value = lambda n: F.lit(getattr(config, n))
        flags, temperature = F.lit(config.flags), F.lit(config.temperature)
    else:
        kinds = ", ".join([*(f"{n}: bigint" for n in (*_WHOLE, "vocabulary")), *(f"{n}: double" for n in _REAL)])
        read = F.from_json("settings", f"struct<{kinds}>")
        value = lambda n: F.when(F.col("settings").isNull(), F.lit(getattr(config, n))).otherwise(F.coalesce(read[n], F.lit(getattr(plain, n))))
        flags, temperature = F.col("flags"), F.rint(F.col("temperature") * 10_000) / 10_000
    on = [F.when(flags.bitwiseAND(bit) > 0, "1").otherwise("0") for bit in (FLAG_NGRAM, FLAG_LZP, FLAG_ADAPTIVE, FLAG_SKIP)]
    real = [*(value(n).cast("double") for n in _REAL), temperature.cast("double"), F.lit(SKIP_NGRAM), F.lit(SKIP_LZP)]
    text = F.concat_ws(",", *on, *(value(n).cast("bigint").cast("string") for n in _WHOLE), *(x.cast("string") for x in real))
    bounds = [value(n).between(*_BOUNDS[n]) for n in _BOUNDS]
    return text, reduce(lambda a, b: a & b, bounds) & (value("lzp_least") <= value("lzp_order"))
