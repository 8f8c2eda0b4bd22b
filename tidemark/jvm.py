"""Java functions for loops that array operations are too slow for.

The source is part of the package.  The compiler that Spark uses for its own plans compiles it
once per session; the class reaches the executors as a jar.  Where that is not possible
``function`` gives None and the caller does the same work in Python.
"""

from __future__ import annotations

import logging
import tempfile
import zipfile
from collections.abc import Callable
from importlib import resources

from pyspark.sql import Column, SparkSession
from pyspark.sql.types import StructType

_FOUND: dict[tuple[str, str], Callable[..., Column] | None] = {}
_log = logging.getLogger(__name__)


def function(spark: SparkSession, package: str, name: str, returns: StructType) -> Callable[..., Column] | None:
    """The function of one column that the class ``tidemark.<name>`` in ``<package>/<name>.java`` is."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _FOUND:
        try:
            _FOUND[key] = _compile(spark, resources.files(package).joinpath(f"{name}.java").read_text(), f"tidemark.{name}", returns)
        except Exception as e:  # whatever is missing: another kind of session, no such compiler, no right to add a jar
            _log.warning("%s is not compiled, its work is done in Python: %s", name, str(e)[:300])
            _FOUND[key] = None
    return _FOUND[key]


def _compile(spark: SparkSession, source: str, name: str, returns: StructType) -> Callable[..., Column]:
    from pyspark.sql.classic.column import _to_java_column

    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
    compiler.cook(source)
    classes = compiler.getBytecodes()
    jar = f"{tempfile.mkdtemp(prefix='tidemark-')}/{name}.jar"
    with zipfile.ZipFile(jar, "w") as out:
        for c in classes.keySet():
            out.writestr(f"{c.replace('.', '/')}.class", bytes(classes[c]))
    spark.sql(f"ADD JAR '{jar}'")
    named = lambda c: jvm.org.apache.spark.util.Utils.classForName(c, True, False)

    def array(kind: object, *values: object) -> object:
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    made = named(name).getDeclaredConstructors()[0].newInstance(array(jvm.java.lang.Object))
    # by its exact types, as several functions are called udf
    types = array(jvm.java.lang.Class, named("org.apache.spark.sql.api.java.UDF1"), named("org.apache.spark.sql.types.DataType"))
    define = named("org.apache.spark.sql.functions").getMethod("udf", types)
    # not deterministic for the optimizer, so that it never calls it twice
    udf = define.invoke(None, array(jvm.java.lang.Object, made, spark._jsparkSession.parseDataType(returns.json()))).asNondeterministic()

    def call(column: Column) -> Column:
        return Column(udf.apply(array(jvm.org.apache.spark.sql.Column, _to_java_column(column))))

    return call
