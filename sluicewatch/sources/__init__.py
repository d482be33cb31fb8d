"""Where telemetry comes from and how its flat form is stored."""
