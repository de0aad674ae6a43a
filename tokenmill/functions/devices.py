"""Tensor-core figures of accelerators, for utilisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PRECISIONS = ("tf32", "bf16", "fp16")
# Chip family; peak TFLOPS in 32-bit mode, with 16-bit brain floats and with 16-bit floats (-1: none); clock in MHz and tensor cores of the reference chip.
FAMILIES = [
    ("volta", 125.0, -1.0, 125.0, 1530.0, 640.0),
    ("ampere_datacenter", 156.0, 312.0, 312.0, 1410.0, 432.0),
    ("ampere_consumer", 40.0, 80.0, 80.0, 1860.0, 336.0),
    ("hopper", 378.0, 756.0, 756.0, 1620.0, 456.0),
    ("ada", 82.6, 165.2, 165.2, 2520.0, 512.0),
]
# Device, family, tensor cores, clock in MHz.
DEVICES = [
    ("Tesla V100-SXM2-16GB", "volta", 640.0, 1530.0),
    ("Tesla V100-PCIE-32GB", "volta", 640.0, 1530.0),
    ("NVIDIA A100-PCIE-40GB", "ampere_datacenter", 432.0, 1410.0),
    ("NVIDIA A100-PCIE-80GB", "ampere_datacenter", 432.0, 1410.0),
    ("NVIDIA A100-SXM4-40GB", "ampere_datacenter", 432.0, 1410.0),
    ("NVIDIA A100-SXM4-80GB", "ampere_datacenter", 432.0, 1410.0),
    ("NVIDIA RTX A2000", "ampere_consumer", 104.0, 1200.0),
    ("NVIDIA RTX A4000", "ampere_consumer", 192.0, 1560.0),
    ("NVIDIA RTX A4500", "ampere_consumer", 224.0, 1650.0),
    ("NVIDIA RTX A5000", "ampere_consumer", 256.0, 1695.0),
    ("NVIDIA RTX A5500", "ampere_consumer", 320.0, 1770.0),
    ("NVIDIA RTX A6000", "ampere_consumer", 336.0, 1800.0),
    ("NVIDIA GeForce RTX 3090 Ti", "ampere_consumer", 336.0, 1860.0),
    ("NVIDIA GeForce RTX 3090", "ampere_consumer", 328.0, 1695.0),
    ("NVIDIA GeForce RTX 3080 Ti", "ampere_consumer", 320.0, 1665.0),
    ("NVIDIA GeForce RTX 3080", "ampere_consumer", 272.0, 1710.0),
    ("NVIDIA GeForce RTX 3070 Ti", "ampere_consumer", 192.0, 1770.0),
    ("NVIDIA GeForce RTX 3070", "ampere_consumer", 184.0, 1725.0),
    ("NVIDIA GeForce RTX 3060 Ti", "ampere_consumer", 152.0, 1665.0),
    ("NVIDIA GeForce RTX 3060", "ampere_consumer", 112.0, 1777.0),
    ("NVIDIA RTX A2000 ADA", "ada", 88.0, 2130.0),
    ("NVIDIA RTX A4000 ADA", "ada", 192.0, 2175.0),
    ("NVIDIA RTX A4500 ADA", "ada", 224.0, 2580.0),
    ("NVIDIA RTX A5000 ADA", "ada", 400.0, 2550.0),
    ("NVIDIA RTX A5880 ADA", "ada", 440.0, 2460.0),
    ("NVIDIA RTX A6000 ADA", "ada", 568.0, 2505.0),
    ("NVIDIA GeForce RTX 4090", "ada", 512.0, 2520.0),
    ("NVIDIA GeForce RTX 4080 SUPER", "ada", 320.0, 2550.0),
    ("NVIDIA GeForce RTX 4080", "ada", 304.0, 2505.0),
    ("NVIDIA GeForce RTX 4070 Ti SUPER", "ada", 264.0, 2610.0),
    ("NVIDIA GeForce RTX 4070 Ti", "ada", 240.0, 2610.0),
    ("NVIDIA GeForce RTX 4070 SUPER", "ada", 224.0, 2475.0),
    ("NVIDIA GeForce RTX 4070", "ada", 184.0, 2475.0),
    ("NVIDIA GeForce RTX 4060 Ti", "ada", 136.0, 2535.0),
    ("NVIDIA GeForce RTX 4060", "ada", 96.0, 2460.0),
    ("NVIDIA H100 PCIe", "hopper", 456.0, 1620.0),
    ("NVIDIA H100 80GB HBM3", "hopper", 528.0, 1830.0),
]


def devices(spark: SparkSession) -> DataFrame:
    """``device, family, cores, clock`` joined with the reference chip's ``tf32, bf16, fp16`` (TFLOPS, null if unknown), ``base_clock, base_cores``."""
    d = spark.createDataFrame(DEVICES, "device string, family string, cores double, clock double")
    rows = [tuple(None if x == -1.0 else x for x in r) for r in FAMILIES]
    f = spark.createDataFrame(rows, "family string, tf32 double, bf16 double, fp16 double, base_clock double, base_cores double")
    return d.join(f, "family")
