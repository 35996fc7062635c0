"""lexlab: labelled-text preparation, scoring, metrics and experiment
comparison as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` (or a
small builder around Spark ML).  Nothing is collected to the driver
except bounded model tables (classes x features) and metric rows
(classes^2 per group).
"""

from lexlab.operators.labels import remap_labels
from lexlab.operators.metrics import classification_report, macro_f1
from lexlab.operators.split import stratified_split
from lexlab.plans.ladder import EXPERIMENTS, run_experiment, run_ladder
from lexlab.session import get_spark, scratch_path
from lexlab.sources.corpus import read_corpus

__all__ = ["EXPERIMENTS", "classification_report", "get_spark", "macro_f1", "read_corpus", "remap_labels",
           "run_experiment", "run_ladder", "scratch_path", "stratified_split"]
