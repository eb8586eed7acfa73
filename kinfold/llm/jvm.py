"""Java functions of this package, for loops that neither SQL expressions nor NumPy can run.

Janino, the compiler that Spark itself ships to compile its generated code, compiles the sources on the driver. The
classes go to the executors in a jar, as those of any job do, and the functions are registered in the session.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.types import DataType

_classes: dict[tuple[str, str], object] = {}


def _compiled(spark: SparkSession, source: str) -> object:
    """The class loader of a source's classes; once for each application."""
    key = (spark.sparkContext.applicationId, source)
    if key not in _classes:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(Path(__file__).with_name(source).read_text())
        found = compiler.getBytecodes()
        jar = Path(tempfile.mkdtemp(prefix="kinfold-jar-"), Path(source).stem + ".jar")
        with zipfile.ZipFile(jar, "w") as z:
            for name in found.keySet():
                z.writestr(name.replace(".", "/") + ".class", bytes(found.get(name)))
        spark.sparkContext._jsc.addJar(str(jar))
        _classes[key] = compiler.getClassLoader()
    return _classes[key]


def register(spark: SparkSession, source: str, name: str, function: str, returns: DataType) -> None:
    """Registers the class `name` of the Java file `source` as the SQL function `function`."""
    gateway = spark.sparkContext._gateway
    cls = _compiled(spark, source).loadClass(name)
    made = cls.getDeclaredConstructor(gateway.new_array(spark._jvm.java.lang.Class, 0)).newInstance(gateway.new_array(spark._jvm.java.lang.Object, 0))
    spark._jsparkSession.udf().register(function, made, spark._jsparkSession.parseDataType(returns.json()))
