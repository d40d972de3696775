"""An extension: the station's bins and run tracking on streams."""
