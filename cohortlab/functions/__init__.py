"""Column functions in one place."""

from cohortlab.operators.clean import cap, risk_binarize
from cohortlab.operators.labels import binary_label, stem
from cohortlab.operators.losses import bce, composite, focal, softplus
from cohortlab.operators.metrics import argmax, ratio
from cohortlab.operators.scoring import layer_norm, linear, mean_pool, sigmoid
from cohortlab.operators.tensor import denormalize, flip_lr, flip_tb, letterbox, normalize, to_channels_first, to_channels_last

__all__ = ["argmax", "bce", "binary_label", "cap", "composite", "denormalize", "flip_lr", "flip_tb", "focal", "layer_norm", "letterbox", "linear", "mean_pool", "normalize", "ratio", "risk_binarize", "sigmoid", "softplus", "stem", "to_channels_first", "to_channels_last"]
