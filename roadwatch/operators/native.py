"""Java classes of this package, compiled by the compiler that Spark brings for its own generated code.

The source beside this file is compiled once per Spark context; the classes go to the executors as a jar.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))
_MADE: dict[tuple[str, str], object] = {}


def tasks(spark: SparkSession, name: str = "BlockTasks"):
    """An object of the class ``roadwatch.name`` in the driver's machine; its Spark jobs find the class on executors."""
    sc = spark.sparkContext
    key = (sc.applicationId, name)
    if key not in _MADE:
        jvm = sc._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        with open(os.path.join(_HERE, f"{name}.java"), encoding="utf-8") as source:
            compiler.cook(source.read())
        folder = tempfile.mkdtemp(prefix="roadwatch-classes-")
        path = os.path.join(folder, f"{name}-{os.path.basename(folder)}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for entry in compiler.getBytecodes().entrySet():
                jar.writestr(f"{entry.getKey().replace('.', '/')}.class", bytes(entry.getValue()))
        sc._jsc.addJar(path)
        urls = sc._gateway.new_array(jvm.java.net.URL, 1)
        urls[0] = jvm.java.io.File(path).toURI().toURL()
        loader = jvm.java.net.URLClassLoader(urls, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        _MADE[key] = loader.loadClass(f"roadwatch.{name}").getConstructor(sc._gateway.new_array(jvm.java.lang.Class, 0)).newInstance(
            sc._gateway.new_array(jvm.java.lang.Object, 0))
    return _MADE[key]
