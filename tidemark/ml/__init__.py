"""Models: walk-forward fitting, calibration and the publishing gate."""
