"""Column-expression helpers. Everything here returns a ``Column`` built from
built-in Spark functions, so it runs JVM-side inside whole-stage codegen."""

from clusterlens.functions.numeric import ieee_div, java_double, java_int, pearson, round_sig
from clusterlens.functions.text import java_split, split_lines, WORD_DELIMITERS
from clusterlens.functions.strings import quoted_csv_split, short_host
from clusterlens.functions.timecols import epoch_micros, epoch_millis, epoch_seconds

__all__ = [
    "ieee_div", "java_double", "java_int", "pearson", "round_sig",
    "java_split", "split_lines", "WORD_DELIMITERS",
    "quoted_csv_split", "short_host",
    "epoch_micros", "epoch_millis", "epoch_seconds",
]
