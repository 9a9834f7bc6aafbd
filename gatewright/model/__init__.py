"""Gate networks as small driver-side values."""
