"""Part of sievemill; see the README."""
