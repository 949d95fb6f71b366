"""What operators share: worker caches, scratch tables."""

from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestone.llm import _common, pretokens
from lodestone.llm._common import lean, self_cleaning, written


def test_pickled_tasks_empty_the_caches_of_others():
    pretokens._power_tables(10)
    for keep, kept in ((("powers",), True), ((), False)):
        task = cloudpickle.loads(cloudpickle.dumps(lean(lambda batches: batches, keep)))
        assert list(task(iter([1, 2]))) == [1, 2] and bool(pretokens._powers) == kept


def test_a_cleaned_function_leaves_its_result_alone(spark):
    made = []

    @self_cleaning
    def inner(n):
        made.append(written(spark.range(n), "in"))
        return made[-1].withColumn("x", F.lit(1))

    @self_cleaning
    def outer():
        made.append(inner(5))
        return made[-1].groupBy("x").agg(F.count(F.lit(1)).alias("n"))

    assert outer().first().n == 5 and not _common._scopes
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = [x.inputFiles() for x in made]
    fs = path(gone[0][0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not any(fs.exists(path(f)) for files in gone for f in files)
