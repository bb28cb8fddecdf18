"""Part of svspark; see README.md."""
