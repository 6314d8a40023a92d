"""Loops over rows in Java, compiled where the session runs by the compiler of Spark's own plans.

The class files travel to the tasks as a jar, as any library of a job does.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession


def kernel(spark: SparkSession, name: str, **words: str):
    """An object of the class ``name``, whose source lies beside this file; ``words`` are replaced in it."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.java"), encoding="utf-8") as f:
        source = f.read()
    for word, by in words.items():
        source = source.replace(word, by)
    context, key = spark.sparkContext, hashlib.sha256(source.encode()).hexdigest()
    # Kept with the context, and not in this module, which travels with functions that name it.
    lock, known = vars(context).setdefault("_hourloom_kernels", (threading.Lock(), {}))
    with lock:
        if key not in known:
            jvm, array = context._jvm, context._gateway.new_array
            compiler = jvm.org.codehaus.janino.SimpleCompiler()
            compiler.setParentClassLoader(spark._jsparkSession.getClass().getClassLoader())
            compiler.cook(source)
            jar = os.path.join(tempfile.mkdtemp(prefix="hourloom-"), f"{name}-{key[:16]}.jar")
            made = compiler.getBytecodes()
            with zipfile.ZipFile(jar, "w") as z:
                for each in made:
                    z.writestr(each.replace(".", "/") + ".class", bytes(made[each]))
            context._jsc.addJar(jar)
            full = next(each for each in made if each.rsplit(".", 1)[1] == name)
            known[key] = compiler.getClassLoader().loadClass(full).getDeclaredConstructor(array(jvm.Class, 0)).newInstance(array(jvm.Object, 0))
        return known[key]
