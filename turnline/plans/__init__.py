"""Named datasets over flights and rotation links."""
