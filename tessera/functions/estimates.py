"""Estimates of what distillation and fine-tuning may give. They are formulas, not measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the estimates.
SPEED_UP = 3.2
BASE, EPOCH_GAIN, EPOCH_MOST = 0.92, 0.005, 0.07
TEMPERATURE_BASE, TEMPERATURE_MOST = 4.0, 1.2
TUNE_MOST, TUNE_RATE = 0.15, 100.0


def student_latency(teacher_ms: Column) -> Column:
    return teacher_ms / SPEED_UP


def student_accuracy(teacher: Column, epochs: Column, temperature: Column) -> Column:
    """Share of the teacher's accuracy, growing with epochs and temperature up to bounds."""
    share = (F.lit(BASE) + F.least(epochs * EPOCH_GAIN, F.lit(EPOCH_MOST))) * F.sqrt(F.least(temperature / TEMPERATURE_BASE, F.lit(TEMPERATURE_MOST)))
    return F.least(F.lit(1.0), teacher * F.least(F.lit(1.0), share))


def accepted(latency: Column, accuracy: Column, target_ms: Column, least: Column) -> Column:
    return (latency <= target_ms) & (accuracy >= least)


def pareto_score(teacher_ms: Column, student_ms: Column, student: Column, teacher: Column) -> Column:
    """Speed-up times the share of accuracy kept."""
    return (teacher_ms / student_ms) * (student / teacher)


def softmax_pair(p: Column, temperature: Column) -> Column:
    """First of the softened probabilities of (p, 1 - p)."""
    a, b = F.exp(p / temperature), F.exp((F.lit(1.0) - p) / temperature)
    return a / (a + b)


def tuning_gain(epochs: Column, rate: Column) -> Column:
    return F.least(F.lit(TUNE_MOST), F.log(F.lit(1.0) + epochs) / 10 * F.least(rate * TUNE_RATE, F.lit(1.0)))


def frozen_layers(asked: Column, layers: Column) -> Column:
    return F.least(asked, layers - 1)
